import os
import time

import numpy as np
import pytest
from colloquy.operators import sound
from colloquy.streaming import meetings as mt
from pyspark.sql import functions as F

KIND = f"rec string, offset long, segments array<{mt.SEGMENT}>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def voice(k, seed=0):
    return (np.eye(6)[k] + 0.05 * np.random.default_rng(seed).normal(size=6)).tolist()


def seg(start, end, who, text, v):
    return {"start": start, "end": end, "speaker": who, "text": text, "vector": v}


def windows():
    """Windows of 60 s, 40 s apart.  In m the first speaker is silent in an overlap and found by voice;
    in n two voices turn out to be one in the end."""
    a, b = voice(0, 1), voice(1, 2)
    m = [
        ("m", 0, [seg(0, 9000, "x", "good morning all", a), seg(42_000, 58_000, "y", "now to the first point", b)]),
        ("m", 40_000, [seg(42_100, 58_000, "p", "now to the first point", b), seg(61_000, 75_000, "q", "another thing altogether", voice(0, 3)), seg(76_000, 77_000, "r", "yes", None)]),
        ("m", 80_000, [seg(90_000, 99_000, "u", "a guest speaks", voice(3, 4)), seg(100_000, 101_000, None, None, [0.0] * 6)]),
    ]
    near = [np.eye(6)[4], 0.58 * np.eye(6)[4] + (1 - 0.58**2) ** 0.5 * np.eye(6)[5]]  # too far to be taken for one as they come
    n = [("n", 40_000 * k, [seg(40_000 * k + 25_000, 40_000 * k + 30_000, f"s{k}", f"turn number {k}", near[k % 2].tolist() if k < 6 else None)]) for k in range(7)]
    return m + n + [("empty", 0, [])]


def as_rows(df):
    return sorted(str((r.rec, r.kind, r.offset, r.start, r.end, r.label, r.speaker, r.text)) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


def test_labels_go_on_are_found_by_voice_or_new(spark):
    got = mt.label_meetings(table(spark, windows()), "rec", 20_000)
    m = [(r.kind, r.label, r.speaker) for r in got.where("rec = 'm'").orderBy("offset", "start").collect()]
    assert m == [("turn", "x", "SPEAKER_0"), ("turn", "y", "SPEAKER_1"), ("repeat", "p", "SPEAKER_1"), ("turn", "q", "SPEAKER_0"), ("turn", "r", "SPEAKER_2"), ("turn", "u", "SPEAKER_3"), ("turn", "", "SPEAKER_4")]
    merged = {(r.label, r.speaker) for r in got.where("kind = 'merge'").collect()}
    turns = mt.relabelled_turns(got, "rec")
    assert turns.count() == got.where("kind = 'turn'").count() and merged == {("SPEAKER_1", "SPEAKER_0")}
    assert [r.speaker for r in turns.where("rec = 'n'").orderBy("start").collect()] == ["SPEAKER_0"] * 6 + ["SPEAKER_2"]


def test_late_and_odd_windows_of_a_table(spark):
    rows = [("m", 0, [seg(0, 10, "a", "x", voice(0))]), ("m", 0, [seg(0, 10, "a", "x", voice(0))]), ("m", 5, None), (None, 0, [seg(0, 1, "a", "x", None)]), ("m", None, [seg(0, 1, "a", "x", None)]), ("z", 0, [seg(5, 5, "a", "", []), seg(5, 2, "b", "t", voice(1))])]
    got = mt.label_meetings(spark.createDataFrame(rows, KIND), "rec", 3).collect()
    assert sorted((r.rec, r.kind, r.speaker or "") for r in got) == [("m", "late", ""), ("m", "turn", "SPEAKER_0"), ("z", "turn", "SPEAKER_0"), ("z", "turn", "SPEAKER_1")]
    assert mt.label_meetings(spark.createDataFrame([], KIND), "rec", 3).count() == 0


def test_a_state_is_the_same_after_it_is_read_back():
    r, s = mt.Recording(20_000), mt.Recording(20_000)
    for _, offset, segments in windows()[:3]:
        a = r.take(offset, segments)
        s = mt.Recording.of(20_000, s.state())
        assert a == s.take(offset, segments)
    assert r.state() == s.state() and r.end() == s.end()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield
    spark.conf.unset(name)


def run(spark, src, out, check, idle_ms, n, then=0):
    """Run until so many windows were taken and so many batches without any followed, then stop."""
    stream = mt.meeting_stream(spark.readStream.schema(KIND).json(src), "rec", 20_000, idle_ms)
    q = mt.to_sinks(stream, out, check).start()
    try:
        end = time.time() + 90
        while time.time() < end:
            done = [p.numInputRows for p in q.recentProgress]
            if sum(done) >= n and len(done) - max(k for k, x in enumerate(done) if x) > then:
                return
            time.sleep(0.2)
        raise AssertionError(f"no end: {done}")
    finally:
        q.stop()


def sinks(spark, out):
    whole = None
    for k in mt.KINDS:
        if os.path.isdir(f"{out}/{k}"):
            p = spark.read.parquet(f"{out}/{k}").withColumn("kind", F.lit(k)).drop("batch")
            whole = p if whole is None else whole.unionByName(p)
    return whole


def states(spark, check):
    return spark.read.format("statestore").option("stateVarName", "meeting").load(check).count()


def test_a_stream_that_restarts_and_ends(spark, rocks, tmp_path):
    src, out, check = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "check")
    rows = windows()
    put = lambda part: spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").json(src)
    first = [r for r in rows if r[1] < 80_000]
    put(first)
    run(spark, src, out, check, 600_000, len(first))  # then the query ends, as if it had failed
    assert states(spark, check) == 3
    rest = [r for r in rows if r[1] >= 80_000]
    put(rest[::-1] + [rows[0]])
    run(spark, src, out, check, 1, len(rest) + 1, 3)  # what is touched in this run ends a moment later
    want = as_rows(mt.label_meetings(table(spark, rows), "rec", 20_000))
    got = sinks(spark, out)
    assert as_rows(got.where("kind <> 'late'")) == want and any("'merge'" in r for r in want)
    assert [(r.rec, r.offset, r.speaker) for r in got.where("kind = 'late'").collect()] == [("m", 0, None)] * 2
    # the recordings that ended have left no state; the one that this run did not touch still waits
    assert states(spark, check) == 1
    put([("m", 120_000, [seg(120_000, 121_000, "a", "too late", voice(0))])])
    run(spark, src, out, check, 1, 1)
    assert [(r.rec, r.offset, r.text) for r in sinks(spark, out).where("kind = 'late' and offset > 0").collect()] == [("m", 120_000, "too late")]


class Loud:
    """A labeler for the test: runs of loud samples, labelled by their sign."""

    def label(self, samples, rate):
        loud = np.abs(samples) > 0.5
        edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
        return [(int(a) * 1000 // rate, int(b) * 1000 // rate, "up" if samples[a] > 0 else "down", f"{b - a} samples") for a, b in zip(edges[::2], edges[1::2], strict=True)]


class Mean:
    dim = 2

    def embed(self, samples, rate):
        return np.array([1.0, samples.mean()]) if len(samples) else np.zeros(2)


def test_labelers_and_embedders_are_plugged_in(spark):
    x = np.concatenate([np.zeros(100), np.ones(200), np.zeros(50), -np.ones(150)])
    df = spark.createDataFrame([("a", 7000, x.tolist()), ("a", 9000, [])], "rec string, offset long, samples array<double>")
    got = {r.offset: r.segments for r in mt.heard(df, "rec", 100, Loud(), Mean()).collect()}
    assert [(s.start, s.end, s.speaker, s.text, s.vector) for s in got[7000]] == [(8000, 10_000, "up", "200 samples", [1.0, 1.0]), (10_500, 12_000, "down", "150 samples", [1.0, -1.0])]
    assert got[9000] == []
    assert mt.label_meetings(mt.heard(df, "rec", 100, Loud(), Mean()), "rec", 0).count() == 2
    with pytest.raises(TypeError):
        mt.heard(df, "rec", 100, object(), Mean())
    assert isinstance(mt.CepstralEmbedder(), mt.Embedder)
    noise = np.random.default_rng(1).normal(size=1600)
    whole = spark.createDataFrame([("a", 0, noise.tolist())], "rec string, start long, samples array<double>")
    assert np.allclose(mt.CepstralEmbedder().embed(noise, 1600), sound.voice_statistics(whole, "rec", 1600).first().vector, atol=1e-6)
    assert not mt.CepstralEmbedder().embed(np.zeros(10), 1600).any()
