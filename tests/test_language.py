import math
import random
import re

import numpy as np
import pytest
from colloquy.functions.text import AMOUNT, DATE, PERCENT
from colloquy.operators import converter, notes, probes
from pyspark.sql import functions as F


# ---------------------------------------------------------------- script conversion
def dictionary(spark, pairs):
    return spark.createDataFrame(pairs, "phrase string, to string")


def convert(spark, texts, *tables, **kw):
    f = converter.converter([dictionary(spark, t) for t in tables], **kw)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r.x for r in df.select("k", f(F.col("t")).alias("x")).orderBy("k").collect()]


def test_the_longest_phrase_wins(spark):
    table = [("头", "頭"), ("发", "發"), ("头发", "頭髮"), ("发生", "發生!"), ("软件", "軟體"), ("一", "1"), ("一二三", "123"), ("", "x"), (None, "y"), ("三", None)]
    got = convert(spark, ["头发生", "发生头发", "软件 is 软, OK", "一二一二三", None, "", "plain, text-1.", "头 发"], table)
    assert got == ["頭髮生", "發生!頭髮", "軟體 is 软, OK", "1二123", None, "", "plain, text-1.", "頭 發"]


def test_ties_chains_and_overrides(spark):
    assert convert(spark, ["干"], [("干", "幹"), ("干", "乾"), ("干", "乾")]) == ["乾"]
    # the second dictionary reads what the first has written, the overrides what both have
    assert convert(spark, ["质量好"], [("质", "質"), ("好", "甲")], [("質量", "質量"), ("甲", "乙丙"), ("乙", "丁")]) == ["品質乙丙"]
    assert convert(spark, ["质量"], [("质", "質")], overrides=[("質", "a"), ("a", "b")]) == ["b量"]
    with pytest.raises(ValueError):
        convert(spark, ["x"], [("a", "b"), ("c", "d")], most=1)


def test_conversion_as_a_slow_scan(spark):
    r = random.Random(3)
    table = {"".join(r.choice("甲乙丙") for _ in range(r.randrange(1, 4))): f"<{k}>" for k in range(20)}
    texts = ["".join(r.choice("甲乙丙 a") for _ in range(40)) for _ in range(50)]

    def slow(t):
        out, at = "", 0
        while at < len(t):
            n = next((n for n in (3, 2, 1) if t[at : at + n] in table and len(t[at : at + n]) == n), 0)
            out += table[t[at : at + n]] if n else t[at]
            at += max(n, 1)
        return out

    assert convert(spark, texts, list(table.items())) == [slow(t) for t in texts]


def test_records_keep_all_but_their_texts(spark):
    kind = "path string, segments array<struct<start:double,speaker:string,text:string>>, meta string"
    df = spark.createDataFrame([("a", [(1.0, "S", "头"), (2.0, None, None), (3.0, "T", "x 头")], "m"), ("b", [], None), ("c", None, "头")], kind)
    out = converter.normalized_records(df, "path", converter.converter([dictionary(spark, [("头", "頭")])]))
    assert out.schema == df.schema
    got = {r.path: r for r in out.collect()}
    assert [tuple(s) for s in got["a"].segments] == [(1.0, "S", "頭"), (2.0, None, None), (3.0, "T", "x 頭")]
    assert got["b"].segments == [] and got["c"].segments is None and got["c"].meta == "头"


# ---------------------------------------------------------------- notes
def slow_notes(lines):
    seen, topics, points, actions = set(), [], [], []
    for who, t in lines:
        t = re.sub(r"\s+", " ", t or "").strip()
        if not t or t[0] == "[":
            continue
        sign = re.sub(r"[\d\s]", "", re.sub(r"^[^:：]*[:：]", "", t))[:24]
        if sign in seen:
            continue
        if any(c in t for c in notes.TOPIC_CUES) and len(topics) < 3:
            topics.append(f"[主題] {t}")
        elif any(c in t or c in t.lower() for c in notes.ACTION_CUES):
            actions.append(f"[待辦] {who}: {t}")
        elif any(re.search(p, t) for p in (PERCENT, AMOUNT, DATE)):
            points.append(f"[重點] {who}: {t}")
        else:
            continue
        seen.add(sign)
    return topics[:2] + points[:6] + actions[:6] or [notes.NOTHING]


def test_notes_are_a_fold(spark):
    r = random.Random(2)
    cues = ["agenda", "議題", "follow UP", "負責", "75%", "21萬", "4/4", "nothing", "[x]", "", "A: 討論", "b：追蹤"]
    windows = {w: [(r.choice("AB"), f"{r.choice(cues)} {r.choice(cues)}  {r.choice(['one', 'two', 'three' * 9])} {r.randrange(30)}") for _ in range(r.randrange(0, 40))] for w in range(30)}
    windows[50] = [("A", None), ("A", "  "), ("A", "[agenda]")]
    windows[51] = [("A", "agenda 1"), ("B", "agenda 2")]  # one signature: the second counts for nothing
    windows[52] = [("A", f"agenda {c}") for c in "abcd"] + [("A", "agenda e 負責"), ("A", "agenda f 9%"), ("A", "agenda d 9%")]
    rows = [(w, k, who, t) for w, ls in windows.items() for k, (who, t) in enumerate(ls)]
    df = spark.createDataFrame(rows, "w long, k long, who string, t string").repartition(3)
    got = {x.w: x.notes for x in notes.window_notes(df, ["w"], "k", "who", "t").collect()}
    assert got == {w: slow_notes(ls) for w, ls in windows.items() if ls}


def test_summaries_have_each_line_once_by_section(spark):
    parts = [["[主題] a", "[重點] A: 1%"], ["[主題] a", "[主題] b ", "[重點] A: 2%", "[待辦] B: x", "[other] y"], ["[主題] c", "[主題] d"] + [f"[重點] A: {k}%" for k in range(9)]]
    df = spark.createDataFrame([("m", w, n) for w, n in enumerate(parts)] + [("none", 0, ["[重點] A: z"])], "m string, w long, notes array<string>")
    got = {r.m: r.summary for r in notes.merged_notes(df, "m", "w", F.lit("T")).collect()}
    points = [f"• A: {k}%" for k in (1, 2, 0, 3, 4, 5, 6, 7)]
    assert got["m"] == "\n".join(["[標題] T", "[摘要]", "議題：a；b；c", *points, "待辦事項：", "- B: x"])
    assert got["none"] == "[標題] T\n[摘要]\n• A: z"


# ---------------------------------------------------------------- logits
def test_divergence_of_long_rows_in_any_parts(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for k, (n, parts, scale) in enumerate([(1, 1, 1), (2, 2, 1), (1000, 7, 5), (5000, 1, 900), (64, 64, 2000)]):
        t, c = r.normal(size=n) * scale, r.normal(size=n) * scale
        if k == 2:
            c[[5, 900]] = c.max() + 1  # two best of equal value in different parts
        for p in np.array_split(np.arange(n), parts):
            rows.append((k, int(p[0]), t[p].tolist(), c[p].tolist()))
        lse = lambda x: x.max() + math.log(np.exp(x - x.max()).sum())
        lt, lc = t - lse(t), c - lse(c)
        want[k] = (float(np.sum(np.exp(lt) * (lt - lc))), int(c.argmax()), float(np.sort(c)[-1] - np.sort(c)[-2]) if n > 1 else None)
    df = spark.createDataFrame(rows, "k long, first long, t array<double>, c array<double>").repartition(5)
    for x in probes.compared(df, ["k"], "first", "t", "c").collect():
        kl, best, margin = want[x.k]
        assert math.isclose(x.kl, kl, rel_tol=1e-9, abs_tol=1e-9) and x.best == best and (margin is None) == (x.margin is None)
        assert margin is None or math.isclose(x.margin, margin, abs_tol=1e-9)
    assert probes.compared(df.limit(0), ["k"], "first", "t", "c").count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 1, 2.0), ("a", 2, 1.5, 9, 1.0), ("b", 3, 0.0, 3, 1.0)], "clip string, best long, kl double, forced long, margin double")
    got = {x.clip: tuple(x)[1:] for x in probes.probe_report(rows, "clip", "forced", F.col("best") == 1).collect()}
    assert got == {"a": (1.0, 50.0, 2.0, 100.0), "b": (0.0, 100.0, None, None)}
    logits = spark.createDataFrame([(1, 0, [0.0, 5.0], 1), (1, 2, [4.0, 1.0], 1), (2, 0, [3.0, 1.0], 3), (2, 2, [0.0, 9.0], 3)], "k long, first long, v array<double>, gold long")
    m = probes.boundary_margins(logits, ["k"], "first", "v", "gold", 1)
    assert sorted(tuple(x) for x in m.collect()) == [(1, True, 1.0), (2, False, 8.0)]
    report = probes.margin_report(m.withColumn("c", F.lit(1)), "c").orderBy("positive").collect()
    assert [tuple(x) for x in report] == [(1, False, 1, 8.0, 0), (1, True, 1, 1.0, 0)]
