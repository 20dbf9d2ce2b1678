"""Metrics and linking without an SQL twin, against values worked out by hand or by brute force."""

import itertools
import random

import numpy as np
import pytest
from colloquy.operators import intervals, metrics, vectors


def segs(spark, rows):
    return spark.createDataFrame([("m", k, s, t, a, b) for k, (s, a, b, t) in enumerate(rows)], "conv_id string, pos int, speaker string, text string, start long, end long")


def test_diarization_error_and_consistency(spark):
    ref = segs(spark, [("a", 0, 5000, "x"), ("b", 5000, 10000, "y")])
    one = metrics.speaker_errors(ref, segs(spark, [("p", 0, 5000, "x")]), "conv_id", collar=0).first()
    assert one.der == pytest.approx(0.5)
    swap = segs(spark, [("q", 0, 5000, "x"), ("p", 5000, 10000, "y")])
    both = metrics.speaker_errors(ref, swap, "conv_id", collar=0).first()
    assert both.der == pytest.approx(0.0) and both.consistency == pytest.approx(1.0)
    same = metrics.speaker_errors(ref, segs(spark, [("p", 0, 10000, "x")]), "conv_id", collar=0).first()
    assert same.der == pytest.approx(0.5) and same.consistency == pytest.approx(0.5)


def test_collar_forgives_a_late_start(spark):
    ref = segs(spark, [("a", 1000, 5000, "x")])
    assert metrics.speaker_errors(ref, segs(spark, [("a", 1200, 5000, "x")]), "conv_id").first().der == 0.0


def test_permutation_error_matches_brute_force(spark):
    r = random.Random(4)
    words = "one two three four".split()
    say = lambda: " ".join(r.choice(words) for _ in range(6))
    ref = [("a", 0, 1, say()), ("b", 1, 2, say()), ("c", 2, 3, say())]
    hyp = [("x", 0, 1, ref[2][3]), ("y", 1, 2, ref[0][3]), ("z", 2, 3, say())]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left = [i]
            for j, y in enumerate(b, 1):
                left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
            row = left
        return row[-1]

    want = min(sum(edits(x[3].split(), y[3].split()) for x, y in zip(ref, p, strict=True)) for p in itertools.permutations(hyp))
    assert metrics.cpwer(segs(spark, ref), segs(spark, hyp), "conv_id").first().edits == want


def test_timestamp_error(spark):
    ref = segs(spark, [("a", 0, 1000, "hello there friend"), ("a", 2000, 3000, "good morning all")])
    hyp = segs(spark, [("a", 100, 1100, "hello there friend")])
    got = metrics.timestamp_error(ref, hyp, "conv_id").first()
    assert (got.matched, got.unmatched, got.mae_ms) == (1, 1, 100.0)


def test_mixed_error_rate(spark):
    row = lambda t: spark.createDataFrame([("m", t)], "conv_id string, text string")
    for ref, hyp, want in (("二〇二五年", "二零二五年", 0.2), ("", "", 0.0), ("", "x", 1.0), ("KPI", "kpi", 0.0)):
        assert metrics.mixed_error_rate(row(ref), row(hyp), "conv_id").first().mer == pytest.approx(want)


def test_average_linkage_against_a_slow_version():
    r = np.random.default_rng(6)
    x = r.normal(size=(14, 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[k] for k in range(len(x))]
    while len(groups) > 1:
        best = min(((np.mean(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), key=lambda t: t[0])
        if best[0] > 0.45:
            break
        groups[best[1]] += groups.pop(best[2])
    got = vectors.average_link(x, 0.45)
    assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got)} == {frozenset(g) for g in groups}


def test_islands_join_across_small_gaps(spark):
    rows = spark.createDataFrame([("u", 0, 10), ("u", 12, 20), ("u", 15, 16), ("u", 40, 50)], "user_id string, start long, end long")
    got = intervals.islands(rows, ["user_id"], "start", "end", 5).groupBy("island").count().collect()
    assert sorted(r["count"] for r in got) == [1, 3]
