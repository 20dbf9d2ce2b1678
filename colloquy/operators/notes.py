"""Notes of a window's lines, and the notes of all windows put together.

Whether a line is taken depends on what earlier lines were taken as: a topic line is one only
while there are fewer than three, and a line is taken once, whatever as.  So a window's lines
are folded in order, in one expression; a window is a few dozen lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import cleaned, salient_facts

# What marks lines as topics and as actions, the letters of a line that tell it from
# others, how many topics are looked for, how many lines of each kind stand in a window's notes
# and in the whole, and what a window without any says.
TOPIC_CUES = ["agenda", "主要是", "議題", "討論"]
ACTION_CUES = ["之前", "會把", "負責", "追蹤", "跟進", "follow up", "交給", "寄給"]
SIGN, TOPICS = 24, 3
NOTE_CAPS, SUMMARY_CAPS = {"[主題]": 2, "[重點]": 6, "[待辦]": 6}, {"[主題]": 3, "[重點]": 8, "[待辦]": 8}
NOTHING = "[主題] （本段無重點事項）"


def _has(text: Column, cues: list[str]) -> Column:
    found = F.lit(False)
    for c in cues:
        found |= F.contains(text, F.lit(c))
    return found


def _line(rows: DataFrame, speaker: str, text: str) -> Column:
    t = F.col("_t")
    sign = F.substring(F.regexp_replace(F.regexp_replace(t, "^[^:：]*[:：]", ""), r"(?U)[\d\s]", ""), 1, SIGN)
    return F.struct(
        t.alias("text"),
        F.concat_ws(": ", F.coalesce(F.col(speaker).cast("string"), F.lit("")), t).alias("said"),
        sign.alias("sign"),
        _has(t, TOPIC_CUES).alias("topic"),
        (_has(t, ACTION_CUES) | _has(F.lower(t), ACTION_CUES)).alias("action"),
        (F.size(salient_facts(t)) > 0).alias("fact"),
    )


def _folded(lines: Column) -> Column:
    """``struct(topics, points, actions)`` of lines in order."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("topics"), none.alias("points"), none.alias("actions"), none.alias("signs"))
    with_ = lambda held, cond, x: F.when(cond, F.concat(held, F.array(x))).otherwise(held)

    def take(held: Column, x: Column) -> Column:
        fresh = ~F.array_contains(held["signs"], x["sign"])
        topic = fresh & x["topic"] & (F.size(held["topics"]) < TOPICS)
        action = fresh & ~topic & x["action"]
        point = fresh & ~topic & ~action & x["fact"]
        return F.struct(
            with_(held["topics"], topic, x["text"]).alias("topics"),
            with_(held["points"], point, x["said"]).alias("points"),
            with_(held["actions"], action, x["said"]).alias("actions"),
            with_(held["signs"], topic | action | point, x["sign"]).alias("signs"),
        )

    return F.aggregate(lines, start, take)


def window_notes(lines: DataFrame, keys: list[str], order: str, speaker: str, text: str) -> DataFrame:
    """``(keys, notes)``: the lines of each window's notes as an array, each with its mark.

    Topics first, then points (lines with a fact), then actions, no more of each than the caps.
    Lines that are null, blank or begin with a bracket count for nothing; a window without a
    line of note says so.
    """
    rows = lines.select(*keys, order, speaker, cleaned(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    rows = rows.withColumn("_line", F.when((F.col("_t") != "") & ~F.startswith("_t", F.lit("[")), _line(rows, speaker, text)))
    ordered = F.array_sort(F.collect_list(F.struct(order, "_line")))
    folded = rows.groupBy(*keys).agg(ordered.alias("_l")).select(*keys, _folded(F.filter(F.transform("_l", lambda x: x["_line"]), lambda x: x.isNotNull())).alias("_f"))
    part = lambda mark, name: F.transform(F.slice(F.col(f"_f.{name}"), 1, NOTE_CAPS[mark]), lambda x: F.concat(F.lit(mark + " "), x))
    notes = F.concat(part("[主題]", "topics"), part("[重點]", "points"), part("[待辦]", "actions"))
    return folded.select(*keys, F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit(NOTHING))).alias("notes"))


def merged_notes(notes: DataFrame, key: str, window: str, title: Column) -> DataFrame:
    """``(key, summary)``: a meeting's title and its windows' notes, each line once, by section.

    Lines stand in the order in which they first appear; no more of each kind than the caps.
    ``title`` is an expression of the key's rows.
    """
    long = notes.select(key, window, F.posexplode("notes").alias("_p", "_l")).withColumn("_l", F.trim("_l"))
    first = long.groupBy(key, "_l").agg(F.min(F.struct(window, "_p")).alias("_at"))
    kind = F.substring("_l", 1, 4)
    caps = F.coalesce(*(F.when(F.col("_k") == m, n) for m, n in SUMMARY_CAPS.items()))
    place = F.row_number().over(Window.partitionBy(key, "_k").orderBy("_at"))
    kept = first.withColumn("_k", kind).withColumn("_n", place).where(F.col("_n") <= caps)
    said = F.trim(F.substring("_l", F.lit(5), F.length("_l")))
    lists = kept.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("_k") == m, F.struct("_n", said.alias("s"))))).alias(f"_{k}") for k, m in enumerate(SUMMARY_CAPS)))
    each = lambda k, mark: F.transform(F.col(f"_{k}"), lambda x: F.concat(F.lit(mark), x["s"]))
    topics = F.when(F.size("_0") > 0, F.array(F.concat(F.lit("議題："), F.array_join(each(0, ""), "；")))).otherwise(F.array())
    actions = F.when(F.size("_2") > 0, F.concat(F.array(F.lit("待辦事項：")), each(2, "- "))).otherwise(F.array())
    titles = notes.select(key, title.alias("_title")).groupBy(key).agg(F.min("_title").alias("_title"))
    whole = F.concat(F.array(F.concat(F.lit("[標題] "), F.coalesce("_title", F.lit(""))), F.lit("[摘要]")), topics, each(1, "• "), actions)
    return lists.join(titles, key).select(key, F.array_join(whole, "\n").alias("summary"))
