import hashlib
import json
import math
import random

import numpy as np
import pytest
from colloquy.operators import fusion, scoring, selection, training_rows
from colloquy.sources import catalogs
from pyspark.sql import functions as F


def test_rounding_as_python_does(spark):
    r = random.Random(1)
    xs = [0.0, 2.675, 1.005, 0.125, 0.375, -0.125, -2.675, 1e11 + 0.125, 2.0**41 + 0.5, float("nan"), float("inf"), 0.285, 1.115, 4.35, -1.005]
    xs += [r.randrange(-(10**9), 10**9) / 8 for _ in range(300)] + [round(r.uniform(-100, 100), 3) for _ in range(3000)] + [r.uniform(-1e9, 1e9) for _ in range(500)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", training_rows.rounded(F.col("x")).alias("two"), training_rows.rounded(F.col("x"), 1).alias("one"), training_rows.rounded(F.col("x"), 0).alias("none"))
    for x in rows.collect():
        for got, digits in ((x.two, 2), (x.one, 1), (x.none, 0)):
            want = round(x.x, digits) if math.isfinite(x.x) and abs(x.x) < 2**40 else x.x
            assert got == want or (math.isnan(want) and math.isnan(got)), (x.x, digits)


def test_fusion_counts_what_it_drops(spark):
    words = [("m", 0, 10_000, 12_000, "a"), ("m", 1, 12_000, 13_000, " "), ("m", 2, 13_000, 13_300, "short"), ("m", 3, 14_000, 16_000, "two voices"), ("m", 4, 16_000, 18_000, "b"), ("m", 5, 90_000, 95_000, "late"), ("m", 6, 20_000, 22_000, "nobody"), ("m", 7, 23_000, 25_000, "little"), ("q", 0, 0, 900, "alone")]
    turns = [("m", 10_000, 13_400, "Z"), ("m", 14_000, 15_000, "Y"), ("m", 15_000, 16_000, "Z"), ("m", 16_000, 18_000, "Y"), ("m", 23_000, 24_000, "Y"), ("q", 0, 900, None)]
    w = spark.createDataFrame(words, "k string, i long, start long, end long, text string")
    t = spark.createDataFrame(turns, "k string, start long, end long, speaker string")
    kept, counts = fusion.fused(w, t, spark.createDataFrame([("m", 60_000), ("q", 900)], "k string, ms long"), "k", "i")
    assert sorted(tuple(x) for x in kept.collect()) == [("m", 0, 5000, 7000, 0, "a"), ("m", 4, 11_000, 13_000, 1, "b")]
    assert {x.k: tuple(x)[1:] for x in counts.collect()}["m"] == (2, 3, 1, 1, 2)


@pytest.mark.parametrize(("rms", "segs", "want"), [(0.0, [(0.0, 9.0, "abcdefghijklmnopqrstu")], "silent"), (0.1, [], "no_structure"), (0.1, None, "no_structure"), (0.1, [(0.0, 7.0, "a" * 30)], "low_coverage"), (0.1, [(0.0, 9.0, "ab")], "density"), (0.1, [(0.0, 8.0, "abc" * 8)], "loop"), (0.1, [(0.0, 8.0, "the quick brown fox jumps"), (9.0, 8.5, "")], "kept")])
def test_the_first_gate_that_fails(spark, rms, segs, want):
    kind = "rms double, s array<struct<start:double,speaker:string,text:string,end:double>>"
    rows = spark.createDataFrame([(rms, None if segs is None else [(a, "", t, b) for a, b, t in segs])], kind)
    assert rows.select(fusion.window_fate(F.col("rms"), F.col("s"), 10.0).alias("f")).first().f == want


def test_records_with_times(spark):
    records = ['{"t":{"w":[{"start":"1"},{"start":2.5}]}}', '{"t":{"w":[{"start":"1"},{}]}}', '{"t":{"w":[]}}', '{"t":"x"}', "no json", None, '{"t":{"w":[{"start":true}]}}', '{"t":{"w":[{"start":null}]}}', '{"t":{"w":[{"start":3}]}}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(records)], "k long, r string")
    assert [x.v for x in df.select("k", fusion.has_times(F.col("r"), "$.t.w").alias("v")).orderBy("k").collect()] == [True, False, False, False, False, False, True, False, True]


def test_health_of_loops_and_nothing(spark):
    seg = [("a", k, 1000 * k, 1000 * k + 500 * (k + 1), "S", "abcabcabcabcabcabc" if k < 2 else " other ") for k in range(3)] + [("b", 0, 5, 9, "S", ""), ("b", 1, 4, 9, "T", "x")]
    got = {x.k: tuple(x)[1:] for x in fusion.health(spark.createDataFrame(seg, "k string, pos long, start long, end long, speaker string, text string"), "k").collect()}
    said = "abc" * 12 + "other"
    grams = [said[i : i + 12] for i in range(len(said) - 12)]
    assert got["a"] == (3, 1, 1000.0, 2, round(1 - 2 / 3, 3), max(map(grams.count, grams)), len(said), True)
    assert got["b"] == (2, 2, 4.5, 1, 0.0, 0, 1, False)


def test_leaks_of_a_script(spark):
    df = spark.createDataFrame([("头a发", "頭a发"), ("", ""), (None, None), ("发发", "髮")], "a string, b string")
    got = [x.v for x in df.select(fusion.script_leak(F.col("a"), F.col("b")).alias("v")).collect()]
    assert [v and (v.cjk, v.changed) for v in got][:2] == [(2, 1), (0, 0)] and (got[3].cjk, got[3].changed) == (1, 1)


def test_sampled_windows(spark):
    r = random.Random(5)
    seg, lengths = [], {}
    for k in range(40):
        at = 0
        for pos in range(r.randrange(1, 30)):
            n = r.randrange(1000, 9000)
            seg.append((k, pos, at, at + n, r.choice("ABC"), f"t{pos}"))
            at += n + r.randrange(0, 4000)
        lengths[k] = at
    s = spark.createDataFrame(seg, "k long, pos long, start long, end long, speaker string, text string")
    d = spark.createDataFrame([*lengths.items(), (99, 5), (98, None)], "k long, ms long")
    got = {}
    for x in training_rows.window_samples(s, d, "k", "pos", 20_000, "seed").orderBy("start").collect():
        got.setdefault(x.k, []).append(x)
    for k, ms in lengths.items():
        room, chosen = ms - 20_000, None
        for t in range(8):
            u = int(hashlib.md5(f"seed:{k}:{t}".encode()).hexdigest()[:8], 16) / 2**32
            off = 0 if room <= 0 else math.floor(u * (room + 1))
            inside = [x for x in seg if x[0] == k and x[2] >= off and x[3] <= off + 20_000]
            chosen = (off, inside)
            if len(inside) >= 2 or room <= 0:
                break
        names = {}
        want = [(chosen[0], p, a - chosen[0], b - chosen[0], names.setdefault(w, len(names) + 1), t) for _, p, a, b, w, t in chosen[1]]
        assert [tuple(x)[1:] for x in got.get(k, [])] == want


def test_weights_of_marks(spark):
    text = "[S01]a[S2][S33]b"
    offsets = [(0, 2), (2, 5), (5, 6), (6, 6), (5, 7), (15, 16)]
    df = spark.createDataFrame([(text, offsets), ("none", [(0, 4)]), ("[S1]", [])], "t string, o array<struct<from:int,to:int>>")
    got = [x.w for x in df.select(training_rows.mark_weights(F.col("o"), F.col("t"), 4.0).alias("w")).collect()]
    assert got == [[4.0, 4.0, 1.0, 1.0, 4.0, 1.0, 1.0], [1.0, 1.0], [1.0]]
    seg = spark.createDataFrame([([(0.5, 1, "hi", 2.25), (3.0, 12, "x", 4.0)],)], "s array<struct<start:double,speaker:int,text:string,end:double>>")
    assert seg.select(training_rows.marked_text(F.col("s")).alias("t")).first().t == "[0.50][S01]hi[2.25][3.00][S12]x[4.00]"


def test_layers_and_levels(spark):
    assert training_rows.layer_pairs(4, 4) == [(0, 0), (1, 1), (2, 2), (3, 3)] and training_rows.layer_pairs(28, 8)[-1] == (27, 7) and training_rows.layer_pairs(2, 5) == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4)]
    with pytest.raises(ValueError):
        training_rows.layer_pairs(0, 1)
    x = np.random.default_rng(1).normal(size=70).astype(np.float32)
    df = spark.createDataFrame([(x.tolist(),), ([0.0] * 5,), ([],)], "x array<float>")
    for bits, block in ((4, 32), (3, 16), (2, 64)):
        top = 2 ** (bits - 1) - 1
        w = np.pad(x, (0, -len(x) % block)).reshape(-1, block)
        scale = np.maximum(np.abs(w).mean(1, keepdims=True, dtype=np.float64).astype(np.float32) if bits <= 2 else (np.abs(w).max(1, keepdims=True) / np.float32(top)), np.float32(1e-8))
        want = (np.clip(np.round(w / scale), -top, top) * scale).ravel()[: len(x)]
        got = [r.q for r in df.select(training_rows.quantised(F.col("x"), bits, block).alias("q")).collect()]
        assert np.array_equal(np.array(got[0], np.float32), want) and got[1] == [0.0] * 5 and got[2] == []


def test_catalogs_scripts_and_clips(spark, tmp_path):
    good = {"IVOD_ID": 7, "委員名稱": "甲", "transcript": {"pyannote": [{"start": 1}], "other": 1}, "影片長度": "1:02"}
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps(good, ensure_ascii=False), "", "{broken", "  [1]  "]), encoding="utf-8")
    c = catalogs.read_catalog(spark, str(tmp_path / "c.jsonl"))
    metas = [json.loads(x.m) for x in c.select(catalogs.catalog_meta(F.col("record")).alias("m")).collect()]
    assert {"ivod_id": 7, "legislator": "甲", "video_length": "1:02", "transcript": {"pyannote": [{"start": 1}]}} in metas and len(metas) == 2
    one = {"speakers": ["A"], "turns": [{"speaker": "A", "text": "hi"}], "domain": "d"}
    (tmp_path / "s.jsonl").write_text("\n".join([json.dumps(one), json.dumps(one | {"language": "en"}), json.dumps({"domain": "x"})]))
    assert sorted((x.language, len(x.turns)) for x in catalogs.read_scripts(spark, str(tmp_path / "s.jsonl")).collect()) == [("en", 1), ("zh-TW-en", 1)]
    kind = "language string, duration double, transcription string, audio struct<bytes:binary,path:string>, other string"
    spark.createDataFrame([("en", 3.0, "a", (b"x", "p"), "o"), ("en", 30.0, "b", (b"y", "p"), "o"), ("de", 1.0, "c", None, "o")], kind).write.parquet(str(tmp_path / "p"))
    clips = catalogs.read_clips(spark, str(tmp_path / "p"), language="en", most_s=10)
    assert [(x.transcription, bytes(x.bytes)) for x in clips.collect()] == [("a", b"x")]
    plan = clips._jdf.queryExecution().toString()
    assert "EqualTo(language,en)" in plan and "other" not in plan.split("ReadSchema")[1]
    rec = spark.createDataFrame([("a.wav", '{"k":1}'), ("b.wav", "{}"), ("c.wav", None)], "audio_path string, meta string")
    got = catalogs.augmented(rec, F.concat(F.lit("x/"), "audio_path")).collect()
    assert [(x.audio_path, json.loads(x.meta)) for x in got] == [("x/a.wav", {"k": 1, "augmented": True}), ("x/b.wav", {"augmented": True}), ("x/c.wav", {"augmented": True})]


def test_scores_of_recordings(spark):
    kind = "k string, pos long, speaker string, text string, start long, end long"
    ref = spark.createDataFrame([("a", 0, "A", "x", 0, 1000), ("a", 1, "B", "y", 1000, 2000), ("b", 0, "A", "z", 0, 100)], kind)
    hyp = spark.createDataFrame([("a", 0, "1", "x", 0, 1000), ("a", 1, "1", "y", 1000, 2000)], kind)
    assert {x.k: tuple(x)[1:3] for x in scoring.speaker_score(ref, hyp, "k").collect()} == {"a": (2, 1), "b": (1, 0)}


def test_passages_of_any_length_are_found(spark):
    docs = ["say that again and again to us", "x and y", "one two three four five six seven eight", "onetwo three", None, "", "two", "a\ttab here"]
    passages = ["that again and again to", "gain and", "two three", "o thr", "one two three four five six seven eight", "wo three four five six seven eig", "zzz", None, "ta", "a\ttab her"]
    d = spark.createDataFrame(list(enumerate(docs)), "i long, t string")
    p = spark.createDataFrame([(x,) for x in passages], "p string")
    got = sorted(r.id for r in selection.containing(d, p, "i", "t", "p").collect())
    assert got == [k for k, t in enumerate(docs) if t is not None and any(x in t for x in passages if x)]
    assert selection.containing(d, p.where("p = 'zzz'"), "i", "t", "p").count() == selection.containing(d, p.limit(0), "i", "t", "p").count() == 0
    with pytest.raises(ValueError):
        selection.containing(d, p, "i", "t", "p", most_short=1)


def test_running_sums_of_a_hot_key_are_many_tasks_work(spark):
    r = random.Random(2)
    rows = [("hot" if k % 3 else r.choice("abc") if k % 2 else None, k, r.choice([None, 1, 2, 5])) for k in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, c long").repartition(5)
    out = selection.running(df, ["k"], [(-F.col("i"))], "c")
    want, seen = {}, {}
    for k, i, c in sorted(rows, key=lambda x: -x[1]):
        place, before = seen.get(k, (0, 0))
        want[i] = (k, place + 1, before)
        seen[k] = (place + 1, before + (c or 0))
    got = {x.i: (x.k, x["_place"], x["_before"]) for x in out.collect()}
    assert got == want and {x["_n"] for x in out.where("k = 'hot'").collect()} == {seen["hot"][0]}
    assert selection.within_budget(df, ["k"], "c", [(-F.col("i"))], 10).columns == df.columns
    assert selection.running(df.limit(0), ["k"], [F.col("i")]).count() == 0
