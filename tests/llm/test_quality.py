import math
import re

import pytest
import xxhash
from colloquy.llm import quality as q

from tests.llm.helpers import edge_rows, empty, frame, prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for k in range(len(w) - 2):
        where.setdefault(tuple(w[k : k + 3]), []).append(k)
    again = {k + j for at in where.values() if len(at) > 1 for k in at for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def grams(t, buckets):
    h = lambda w, seed=42: xxhash.xxh64_intdigest(w, seed)
    raw = lambda w: h(w.encode()).to_bytes(8, "little")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    w = words(t)
    return [signed(h(x.encode())) % buckets for x in w] + [signed(h(raw(b), h(raw(a)))) % buckets for a, b in zip(w, w[1:], strict=False)]


ROWS = [*edge_rows(), (20, "same line here\nsame line here\nother | # $ % line\n\nsame line here"), (21, prose(8, 60) + " # & <b>")]


def test_base_counts_and_ratio_agree_with_brute_force(spark):
    trusted, buckets = [1, 8, 21], 512
    raw, target = [0] * buckets, [0] * buckets
    for i, t in ROWS:
        for b in grams(t, buckets):
            raw[b] += 1
            target[b] += i in trusted
    llr = [math.log((t + 1) / (sum(target) + buckets)) - math.log((r + 1) / (sum(raw) + buckets)) for r, t in zip(raw, target, strict=True)]
    ids = spark.createDataFrame([(i,) for i in [*trusted, None, 1]], "doc_id long")
    out = q.quality_rules(frame(spark, ROWS), ids, buckets=buckets).collect()
    assert len(out) == len(ROWS)
    by = {}
    for i, t in ROWS:
        by.setdefault(i, t)
    for r in out:
        t = by[r.doc_id]
        n, chars, symbols, dup, rep = base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r.doc_id
        g = grams(t, buckets)
        want = sum(llr[b] for b in g) / len(g) if g else 0.0
        assert r.llr == pytest.approx(want, abs=1e-9)
        failed = n < 50 or 100 * rep > 50 * n
        assert r.base_failed == failed and r.kept == (not failed and want >= q.THRESHOLD)
        assert r["rank"] == "other" and r["_words"] == "other"


def test_no_trusted_rows_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert q.quality_rules(frame(spark, ROWS), none).count() == len(ROWS)
    assert q.quality_rules(empty(spark), none).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    plan = q.op3_quality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_query_agrees_with_brute_force_on_whole_texts(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = q.op3_quality(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        n, *rest = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[3] > 50 * n) and r.kept == (not r.base_failed and r.llr >= q.THRESHOLD)
