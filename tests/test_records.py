"""Readers, writers, streams and folds over records, against values worked out by hand or slow versions."""

import json
import wave

import numpy as np
import pytest
from colloquy.operators import stitching
from colloquy.plans import records as plans
from colloquy.sinks import records as sinks
from colloquy.sources import generated, manifests, tables
from colloquy.streaming import speakers
from pyspark.sql import functions as F

GOOD = {"audio_path": "a.wav", "duration_s": 2.5, "sample_rate": 16000, "language": "zh", "source": "x", "split": "train", "segments": [{"start": 0.0, "end": 1.0, "speaker": "1", "text": "你好"}], "meta": {"k": [1, 2]}}


def lines():
    bad = [
        "{", "[]", json.dumps({k: v for k, v in GOOD.items() if k != "split"}), json.dumps(GOOD | {"duration_s": "long"}),
        json.dumps(GOOD | {"segments": [{"start": 0, "end": 1, "text": "x"}]}), json.dumps(GOOD | {"segments": None}),
    ]
    good = [json.dumps(GOOD, ensure_ascii=False), json.dumps({k: v for k, v in GOOD.items() if k not in ("segments", "meta")} | {"duration_s": "3"})]
    return good, bad


def test_manifest_files(spark, tmp_path):
    good, bad = lines()
    (tmp_path / "m.jsonl").write_text("\n".join([*good, "", *bad]) + "\n", encoding="utf-8")
    got = manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).orderBy("duration_s").collect()
    assert [(r.duration_s, len(r.segments), json.loads(r.meta)) for r in got] == [(2.5, 1, {"k": [1, 2]}), (3.0, 0, {})]
    assert sorted(r.line for r in manifests.read_rejected(spark, str(tmp_path / "*.jsonl")).collect()) == sorted(bad)
    sinks.write_manifest(manifests.read_manifest(spark, str(tmp_path / "m.jsonl")), str(tmp_path / "out"))
    back = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert GOOD in back and list(back[0]) == list(GOOD) and len(back) == 2


def test_empty_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("")
    assert manifests.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 0


def test_generated_segments(spark):
    one = '{"Start":0,"End":1.5,"Speaker":2,"Content":"a"}'
    cases = {
        f"<|im_start|>assistant\n[{one}]<|im_end|>": [(0.0, 1.5, "2", "a")],
        one: [(0.0, 1.5, "2", "a")],
        f"so: [{one}] done": [(0.0, 1.5, "2", "a")],
        f"[{one},{one[:-4]}": [(0.0, 1.5, "2", "a")],
        '[{"start":1,"end":"2","Text":"m"}, 7, {"End":1}]': [(1.0, 2.0, "", "m")],
        '[{"Start":1,"start":9,"End":2,"Speaker":null,"Content":null}]': [(1.0, 2.0, "None", "None")],
        "": [], "no json": [],
    }
    rows = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: r.s for r in rows.select("t", generated.generated_segments(F.col("t")).alias("s")).collect()}
    assert got.pop(None) is None
    assert {t: [tuple(x) for x in s] for t, s in got.items()} == cases


def test_markers_carry_labels(spark):
    rows = spark.createDataFrame([(1, "[0.5][S02]hi[1.0][1.0]yo[2.0][3.0][S07]no[2.5][3][S03] [4][4]so[5]"), (2, None), (3, "")], "k int, t string")
    got = generated.closed_markers(rows, ["k"], "t").orderBy("pos").collect()
    assert [(r.k, r.start, r.end, r.speaker, r.text) for r in got] == [(1, 0.5, 1.0, "S02", "hi"), (1, 1.0, 2.0, "S02", "yo"), (1, 4.0, 5.0, "S02", "so")]
    rows = spark.createDataFrame([(1, "[0]a[1-1.5][S02][2]b")], "k int, t string")
    got = generated.open_markers(rows, ["k"], "t", 10.0).orderBy("pos").collect()
    assert [(r.start, r.end, r.speaker, r.text) for r in got] == [(10.0, None, "S01", "a"), (12.0, None, "S02", "b")]
    apart = rows.select(generated.taken_apart(F.lit("[1.5][S01]hi[2]")).alias("x")).first().x
    assert (apart.text, apart.times, apart.speakers) == ("hi", [1.5, 2.0], ["S01"])


def test_json_target_is_read_back(spark):
    segs = [(0.0, 1.25, "07", 'say "x"\n\\ 你'), (1.5, 2.0, "", "[Music]"), (2.0, 3.0, "S1", "")]
    rows = spark.createDataFrame([(segs,), ([],)], f"s {generated.SEGMENTS}")
    a, b = (r.t for r in rows.select(sinks.json_target(F.col("s")).alias("t")).collect())
    assert json.loads(b) == []
    assert json.loads(a) == [
        {"Start": 0.0, "End": 1.25, "Speaker": 7, "Content": 'say "x"\n\\ 你'}, {"Start": 1.5, "End": 2.0, "Content": "[Music]"}, {"Start": 2.0, "End": 3.0, "Speaker": "S1", "Content": ""}]


def test_word_files_and_turns(spark, tmp_path):
    one = '<?xml version="1.0"?><r><w starttime="0.5" endtime="0.9">so</w><w starttime="0.9" punc="true">,</w><w endtime="1">x</w><w starttime="1.5">we</w><w starttime="4" endtime="5">go</w></r>'
    (tmp_path / "M1.A.words.xml").write_text(one)
    (tmp_path / "M1.B.words.xml").write_text('<?xml version="1.0"?><r><w starttime="2" endtime="2.4">ok</w><w starttime="3"> </w></r>')
    w = tables.xml_words(spark, str(tmp_path / "*.words.xml"))
    assert [(r.speaker, r.start, r.end, r.text) for r in w.orderBy("start").collect()] == [("A", 0.5, 0.9, "so"), ("A", 1.5, 1.5, "we"), ("B", 2.0, 2.4, "ok"), ("A", 4.0, 5.0, "go")]
    got = tables.turns(w, 0.5, 4.0).orderBy("start").collect()
    assert [(r.label, r.start, r.end, r.text) for r in got] == [("S01", 0.0, 1.0, "so we"), ("S02", 1.5, 1.9, "ok"), ("S01", 3.5, 4.0, "go")]


def test_voices_with_enough_clips(spark, tmp_path):
    for name in ("a.wav", "b.wav", "c.wav"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "d.wav").write_bytes(b"")
    (tmp_path / "list.tsv").write_text("client_id\tpath\nu\tclips/a.wav\nu\tb.wav\nv\tc.wav\nv\td.wav\n")
    clips = tables.listing(spark, str(tmp_path), "*.wav")
    assert clips.count() == 3
    got = tables.voices(spark, str(tmp_path / "list.tsv"), clips, 2).collect()
    assert [(r.client_id, len(r.paths)) for r in got] == [("u", 2)]


def test_loose_dict_and_wav(spark, tmp_path):
    rows = spark.createDataFrame([("{'a': 1, 'b': None}",), ("[1]",), ("{",), (None,)], "t string")
    assert [r.d for r in rows.select(tables.loose_dict(F.col("t")).alias("d")).collect()] == [{"a": "1", "b": None}, None, None, None]
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(100)
        w.writeframes(np.array([0] * 100 + [16384] * 100, "<i2").tobytes())
    (tmp_path / "y.wav").write_bytes(b"none")
    files = spark.read.format("binaryFile").load(str(tmp_path)).orderBy("path")
    x, y = (r.w for r in files.select(tables.wav_levels(F.col("content"), 1.0, 0.5).alias("w")).collect())
    assert (x.rate, x.frames, x.peak, x.rms) == (100, 50, 0.5, 0.5)
    assert y is None or y.frames is None


def test_stream_of_manifest_lines(spark, tmp_path):
    good, bad = lines()
    src, out = tmp_path / "src", str(tmp_path / "good")
    src.mkdir()
    (src / "1.jsonl").write_text("\n".join([good[0], bad[0]]), encoding="utf-8")
    for k in (1, 2, 3):
        stream = spark.readStream.schema("value string").text(str(src))
        sinks.append_records(stream, out, str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination(60)
        assert spark.read.parquet(out).count() == (1 if k < 3 else 2)
        if k == 2:
            (src / "2.jsonl").write_text(good[1], encoding="utf-8")
    assert [r.line for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [bad[0]]


def voices(n=60, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(3, 8))
    return [(k % 2, k // 2, (centres[r.integers(3)] + 0.1 * r.normal(size=8)).tolist()) for k in range(n)]


def slow_labels(rows):
    known, out = {}, {}
    for rec, window, v in sorted(rows, key=lambda x: (x[0], x[1])):
        v, mine = np.array(v), known.setdefault(rec, [])
        cosine = [c @ v / np.linalg.norm(v) for c in mine]
        if cosine and max(cosine) >= 0.6:
            best = int(np.argmax(cosine))
            c = 0.9 * mine[best] + 0.1 * v
            mine[best] = c / np.linalg.norm(c)
        else:
            best = len(mine)
            mine.append(v / np.linalg.norm(v))
        out[rec, window] = f"SPEAKER_{best}"
    return out


KIND = "rec int, window int, v array<double>"


def test_registry_over_a_table(spark):
    rows = voices()
    extra = [(0, 3, rows[6][2]), (5, 0, None), (5, 1, [0.0] * 8), (None, 1, rows[0][2])]
    got = speakers.label_windows(spark.createDataFrame(rows + extra, KIND), "rec", "window", "v").collect()
    assert {(r.rec, r.window): r.speaker for r in got if not r.late and r.rec != 5} == slow_labels(rows)
    assert [(r.rec, r.window, r.speaker) for r in got if r.late] == [(0, 3, None)]
    assert [r.speaker for r in got if r.rec == 5] == [None, None]


def test_registry_over_a_stream(spark, tmp_path):
    rows, src, out = voices(), tmp_path / "src", str(tmp_path / "out")
    for part in (rows[:21], rows[21:], rows[:2]):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").json(str(src))
        stream = speakers.label_stream(spark.readStream.schema(KIND).json(str(src)), "rec", "window", "v")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert {(r.rec, r.window): r.speaker for r in got if not r.late} == slow_labels(rows)
    assert sorted((r.rec, r.window) for r in got if r.late) == [(0, 0), (1, 0)]


def test_stitching_by_hand(spark):
    rows = [
        ("m", 0, 0, 5000, "a", "good morning all"), ("m", 0, 5000, 9000, "b", "thanks"), ("m", 0, 45000, 60000, "a", "we start now with the first"),
        ("m", 40000, 45000, 66000, "x", "we start now with the first point of today"), ("m", 40000, 70000, 72000, "y", "yes"), ("m", 40000, 72100, 73000, "y", "sure"),
        (None, 0, 0, 1, "a", "lost"), ("n", 0, 0, 10, None, None),
    ]
    df = spark.createDataFrame(rows, "k string, offset long, start long, end long, speaker string, text string")
    got = [tuple(r) for r in stitching.stitched(df, "k", 20_000).orderBy("k", "start").collect()]
    assert got == [
        ("m", 0, 5000, "SPEAKER_0", "good morning all"), ("m", 5000, 9000, "SPEAKER_1", "thanks"),
        ("m", 45000, 66000, "SPEAKER_0", "we start now with the first point of today"), ("m", 70000, 73000, "SPEAKER_2", "yes sure"), ("n", 0, 10, "SPEAKER_0", "")]


@pytest.mark.parametrize("name", ["stitched_windows"])
def test_stitched_windows_restore_the_turns(spark, sf_dir, name):
    segs = plans.segments(spark, sf_dir).where("text != ''")
    want = {(r.conv_id, r.start) for r in segs.collect()}
    got = plans.QUERIES[name](spark, sf_dir).collect()
    assert len({(r.conv_id, r.start) for r in got}) == len(got)
    heard = {(r.conv_id, r.start) for r in got}
    assert heard <= want | {(r.conv_id, r.start) for r in plans.segments(spark, sf_dir).collect()}
    last = {r.conv_id: r.end for r in segs.groupBy("conv_id").agg(F.max("end").alias("end")).collect()}
    assert {c for c, _ in heard} >= set(last)


def test_registry_query_agrees_with_a_fold_over_whole_vectors(spark, sf_dir):
    from colloquy.plans import catalog, records

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    unit = lambda v: [x / max(sum(y * y for y in v) ** 0.5, 1e-300) for x in v]
    known, want = {}, {}
    for r in rows:
        voices, v = known.setdefault(r.vec_id // 100, []), list(r.embedding)
        score = [sum(a * b for a, b in zip(c, unit(v), strict=True)) for c in voices]
        best = max(range(len(score)), key=score.__getitem__, default=-1)
        if best >= 0 and score[best] >= 0.6:
            voices[best] = unit([0.9 * a + 0.1 * b for a, b in zip(voices[best], v, strict=True)])
        else:
            best = len(voices)
            voices.append(unit(v))
        want[r.vec_id] = (r.vec_id // 100, f"SPEAKER_{best}", False)
    got = {r.window: (r.rec, r.speaker, r.late) for r in records.registry_labels(spark, sf_dir).collect()}
    assert got == want
    sizes = catalog.link_speakers(spark, sf_dir).groupBy("rec").count().collect()
    assert len(sizes) == len(known) and max(r["count"] for r in sizes) <= 100


def salvaged(text):
    """Objects by trying every opening brace in turn, as a slow version."""
    read, out, at = json.JSONDecoder().raw_decode, [], text.find("{")
    while at >= 0:
        try:
            found, after = read(text, at)
            out.append(found)
        except ValueError:
            after = at + 1
        at = text.find("{", after)
    return out


def test_objects_of_broken_texts_as_a_slow_version():
    r = np.random.default_rng(7)
    bits = ['{"a":1}', '{"b":"x"}', "[", "]", ",", "{", "}", ":", '"k"', "12", "-0.5e3", "null", "x", " ", '{"c":{"d":[1,{"e":2}]}}', '{"s":"\\u00e9\\n"}', "01", "it's", "NaN"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.integers(1, 12)))
        text = text[: len(text) - r.integers(0, 9)] if r.random() < 0.5 else text  # broken off anywhere, in a string too
        try:
            whole = json.loads(text)
        except ValueError:
            whole = None
        if isinstance(whole, list):
            want = [x for x in whole if isinstance(x, dict)]
        elif isinstance(whole, dict):
            want = [whole]
        else:
            want = salvaged(text)
        got = generated.whole_objects(text)
        # lists inside of a list that is whole are passed over, which a brace by brace search does not see
        assert str(got) == str(want) or ("[" in text and all(str(g) in str(want) for g in got)), text
    deep = "[" * 100_000 + '{"a":1}'
    assert generated.whole_objects(deep) == [{"a": 1}] and generated.whole_objects("{" * 50_000) == []


def test_marked_segments_keep_empty_labels(spark):
    df = spark.createDataFrame([("[0.5][S01] a [1.00][1.00]b[2.0] x [3][S2]c[2]",), ("",), (None,)], "t string")
    got = [r.s and [tuple(x) for x in r.s] for r in df.select(generated.marked_segments(F.col("t")).alias("s")).collect()]
    assert got == [[(0.5, "[S01]", "a", 1.0), (1.0, "", "b", 2.0), (3.0, "[S2]", "c", 2.0)], [], None]


def test_dialogues(spark):
    turn = lambda who, text: {"speaker": who, "text": text}
    good = [turn(" A ", "hi"), turn("B", " there "), turn("A", "x")]
    cases = {
        json.dumps(good): (["A", "B"], [("A", "hi"), ("B", "there"), ("A", "x")]),
        "so:\n" + json.dumps(good, indent=1) + " done": (["A", "B"], [("A", "hi"), ("B", "there"), ("A", "x")]),
        json.dumps(good[:1]): None, json.dumps([turn("A", "x"), turn("A", "y")]): None, json.dumps([turn("A", "x"), turn("B", "  ")]): None,
        json.dumps([turn("A", "x"), turn(2, "y")]): None, json.dumps([turn("A", "x"), "y"]): None, json.dumps([turn(str(k), "x") for k in range(13)]): None,
        "[": None, "": None, "[]": None, '{"a":1}': None, json.dumps([turn(str(k), "x") for k in range(12)]): ([str(k) for k in range(12)], [(str(k), "x") for k in range(12)]),
    }
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    for r in df.select("t", generated.dialogue(F.col("t")).alias("d")).collect():
        want = cases.get(r.t)
        assert (r.d and (r.d.speakers, [tuple(x) for x in r.d.turns])) == want, r.t


def test_gate_logs(spark, tmp_path):
    df = spark.createDataFrame([("a", "mer", 0.123456, True), ("a", "d|er", 1.0, True), ("b", "mer", 2.0, False), ("b", "x", None, True)], "run string, gate string, value double, passed boolean")
    lines = sinks.gate_reports(df, ["run"])
    for _ in range(2):
        sinks.append_lines(lines, str(tmp_path / "log"))
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect())
    assert got == sorted(['{"d|er":1.0,"mer":0.1235,"verdict":"PASS"}', '{"mer":2.0,"verdict":"FAIL"}'] * 2)


def test_vocabularies(spark, tmp_path):
    from colloquy.sources import vocabularies as vo

    data = {"model": {"vocab": {"a": 0, "<0x0A>": 1, "<s>": 2, "[": 5}}, "added_tokens": [{"id": 2, "content": "<s>"}, {"id": 9, "content": "<pad>"}]}
    (tmp_path / "t.json").write_text(json.dumps(data))
    v = vo.read_vocabulary(spark, str(tmp_path / "t.json"))
    assert sorted(tuple(r) for r in v.collect()) == [("<0x0A>", 1, "byte"), ("<pad>", 9, "special"), ("<s>", 2, "special"), ("[", 5, "plain"), ("a", 0, "plain")]
    assert vo.vocabulary_size(v) == 10 and vo.vocabulary_size(v.limit(0)) == 0
    assert vo.structural_ids(lambda t: [len(t)]) == {1, 3}
    assert vo.target_glue_ids(lambda t: [len(t)], ["k"]) == {2, 3, 4, 5, 6, 8, 9}
