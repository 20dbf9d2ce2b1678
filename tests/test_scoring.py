import random
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from colloquy import registry
from colloquy.functions import edits
from colloquy.functions import writing as W
from colloquy.operators import consolidation, scoring
from pyspark.sql import functions as F


def table(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def test_alignment_is_the_preferred_way_back_through_the_table():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randrange(14))] for _ in range(2))
        d, i, j, want = table(a, b), len(a), len(b), []
        while i or j:
            if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                want.append((i, j))
            elif i and d[i][j] == d[i - 1][j] + 1:
                i -= 1
                want.append((i, None))
            else:
                j -= 1
                want.append((None, j))
        assert edits.alignment(a, b) == want[::-1]


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("二十三", 23), ("十", 10), ("十二", 12), ("一百零五", 105), ("兩千三百", 2300), ("一萬零三十", 10030), ("三億二千萬", 320_000_000),
        ("二零二四", 2024), ("一百二", None), ("百五十", None), ("", None), ("一千一", None),
    ],
)
def test_numerals(said, want):
    assert W.number_of(said) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("成長百分之五十，百分之二點五", "成長50%，2.5%"), ("萬一來了三十人", "萬一來了30人"), ("一個十分鐘", "一個十分鐘"), ("三心二意", "三心二意"),
        ("預算二十一萬", "預算210000"), ("no numerals 7", "no numerals 7"), ("", ""), (None, None),
    ],
)
def test_numbers_are_written(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(W.numbers_written(F.col("t")).alias("x")).first().x == want


def test_every_number_comes_back(spark):
    got = spark.range(0, 10_000, 37).select("id", W.spelled(F.col("id")).alias("s")).collect()
    assert all(W.number_of(r.s) == r.id for r in got)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("今天的產品站立會議開始，agenda 是 Roadmap，還有別的。", "產品站立會議：Roadmap"), ("主要是 review 預算時間控制，好", "會議：預算"),
        ("x" * 200 + "客戶會議", "客戶會議"), ("hello", "會議"), (None, "會議"),
    ],
)
def test_titles(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(W.title(F.col("t")).alias("x")).first().x == want


def test_words_marks_shards_and_likeness(spark):
    df = spark.createDataFrame([("Don't ＫＰＩ-2 是A好_x", "[1.00][S01]a, b。[2.50][2.50][S02]c[3]"), (None, None)], "t string, m string")
    rows = df.select(W.scorer_tokens(F.col("t")).alias("w"), W.without_marks(F.col("m")).alias("p"), W.marked_segments(F.col("m")).alias("n")).collect()
    assert rows[0].w == ["don", "t", "kpi", "2", "是", "a", "好", "_", "x"] and rows[0].p == "abc" and rows[0].n == 2
    assert rows[1].w == [] and rows[1].p is None
    pair = spark.createDataFrame([("a same text, here", "the same text here"), (None, "x"), ("", None)], "a string, b string")
    got = pair.select(W.agreement(F.col("a"), F.col("b")).alias("g"), W.likeness(F.col("a"), F.col("b")).alias("l"), W.shard_of(F.col("b"), 7).alias("s")).collect()
    assert got[0].l == SequenceMatcher(None, "asametexthere", "thesametexthere").ratio() and got[0].s == zlib.crc32(b"the same text here") % 7
    held = sum(m.size for m in SequenceMatcher(None, "a same text, here", "the same text here", autojunk=False).get_matching_blocks())
    assert got[0].g == 100 * held / 18 and got[1].g == 0 and got[2].g == 0


def test_four_axes(spark):
    kind = "k long, start long, pos long, speaker string, token string"
    ref = [(1, 1000 * i, i, "A" if i < 5 else "B", t) for i, t in enumerate("a b c d e f g h i j".split())] + [(2, 0, 0, "A", "z")]
    hyp = [(1, 1000 * i + 10 * i, i, "x" if i < 6 else "y", t) for i, t in enumerate("a b c d e f g h i j".split()) if t != "c"]
    got = {r.k: r for r in scoring.four_axes(spark.createDataFrame(ref, kind), spark.createDataFrame(hyp, kind), "k").collect()}
    a = got[1]
    assert (a.n_ref, a.errors, a.matched, a.deletions, a.insertions, a.wer) == (10, 1, 9, 1, 0, 0.1)
    gaps = sorted(10 * i for i in range(10) if i != 2)
    assert a.onset_median == gaps[4] and a.onset_p90 == gaps[8] and a.within_1s == 1
    assert a.speaker_accuracy == 8 / 9
    assert got[2].matched == 0 and got[2].wer == 1 and got[2].onset_median is None


def _voices(spark):
    east, north = [1.0, 0.05, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, k, float(k), k + 1.0, f"SPEAKER_{k % 2 + 10 * (k > 5)}", east if k < 6 else north) for k in range(12)]
    rows += [(1, 12, 12.0, 13.0, "SPEAKER_2", [0.9, 0.1, 0.0]), (1, 13, 13.0, 14.0, "[Noise]", [0.0, 0.0, 0.0]), (2, 0, 0.0, 1.0, "SPEAKER_4", north)]
    return spark.createDataFrame(rows, "rec long, n long, start double, end double, speaker string, vector array<double>")


def test_consolidation(spark):
    v = _voices(spark)
    m = consolidation.merge_map(consolidation.speaker_means(v, "rec", "speaker", "vector"), "rec", "speaker")
    assert {(r.rec, r.speaker, r.mapped) for r in m.collect()} == {(1, "SPEAKER_1", "SPEAKER_0"), (1, "SPEAKER_11", "SPEAKER_10"), (1, "SPEAKER_2", "SPEAKER_0")}
    got = consolidation.relabelled(v, m, "rec", "speaker").groupBy("rec", "speaker").count().collect()
    assert {(r.rec, r.speaker, r["count"]) for r in got} == {(1, "SPEAKER_0", 7), (1, "SPEAKER_10", 6), (1, "[Noise]", 1), (2, "SPEAKER_4", 1)}
    assert m.limit(0).count() == 0 and consolidation.relabelled(v.limit(0), m, "rec", "speaker").count() == 0


def test_reclustering(spark):
    v = _voices(spark)
    store = v.where("speaker <> '[Noise]'")
    again = store.unionByName(store.where("n = 0 and rec = 1").withColumns({"n": F.lit(99).cast("long"), "vector": F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))}))
    got = {(r.rec, r.n): r.speaker for r in consolidation.reclustered(v.drop("vector"), again.drop("speaker"), "rec", "speaker", "n").collect()}
    # the later vector of the first segment puts it with the other voice, which so speaks first
    assert got[1, 0] == got[1, 7] == "SPEAKER_0" and got[1, 1] == got[1, 12] == "SPEAKER_1"
    assert got[1, 13] == "[Noise]" and got[2, 0] == "SPEAKER_4"
    assert len(got) == 15 and np.unique([*got.values()]).size == 4


@pytest.mark.parametrize("name", ["turn_agreement", "crc_shards", "four_axis_scores", "consolidated_speakers", "reclustered_speakers"])
def test_queries_without_sql_keep_their_rows(spark, sf_dir, name):
    rows = registry.queries()[name](spark, sf_dir)
    whole = {"four_axis_scores": ("conversations", "conv_id"), "consolidated_speakers": ("embeddings", "vec_id"), "reclustered_speakers": ("embeddings", "vec_id")}
    n = rows.count()
    assert n > 0
    if name in whole:
        t, key = whole[name]
        assert n == spark.read.parquet(f"{sf_dir}/{t}.parquet").select(key).distinct().count()
