"""Segments of one recogniser under the speakers of another, gates of labelled windows, health reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import loops
from colloquy.operators.intervals import overlaps, sustained_start
from colloquy.operators.selection import first_reason

# Fixed values of the fusion: shortest and longest segment in ms, the share of the overlap that
# the best speaker must have and the share of the segment that they must cover; of the gates: the
# least loudness, the least share of a window under markers, letters a second, repeats in a row.
SHORTEST_MS, LONGEST_MS, DOMINANT, COVERED = 400, 30_000, 0.75, 0.7
SILENT, LEAST_COVERED, LEAST_RATE, MOST_RATE, REPEATS = 1e-3, 0.75, 1.5, 12.0, 4
_BIN = 60_000


def _placed(words: DataFrame, turns: DataFrame, durations: DataFrame, key: str, item: str) -> DataFrame:
    """Segments from where speech begins, with the fate of each and the speaker who has most of it."""
    skip = sustained_start(words.select(key, "start"), [key], "start", 60_000, 3, 5000).withColumnRenamed("start", "_skip")
    w = words.where(F.trim("text") != "").join(skip, key).join(durations.select(key, F.col("ms").alias("_ms")), key)
    w = w.withColumns({"start": F.col("start") - F.col("_skip"), "end": F.col("end") - F.col("_skip")})
    t = turns.join(skip, key).select(key, (F.col("start") - F.col("_skip")).alias("start"), (F.col("end") - F.col("_skip")).alias("end"), F.struct("speaker", "start").alias("b_id"))
    both = overlaps(w.where("start < end").select(key, "start", "end", F.col(item).alias("a_id")), t.where("start < end"), [key], _BIN)
    by = both.groupBy(key, F.col("a_id").alias(item), F.col("b_id.speaker").alias("speaker")).agg(F.sum("overlap").alias("ms"), F.min("b_id.start").alias("first"))
    # of equal shares the one who spoke first
    best = by.groupBy(key, item).agg(F.max(F.struct("ms", (-F.col("first")).alias("first"), "speaker")).alias("_best"), F.sum("ms").alias("_all"))
    w = w.join(best, [key, item], "left")
    long = F.col("end") - F.col("start")
    lost = F.col("_all").isNull() | (F.col("_best.ms") < F.col("_all") * DOMINANT) | (F.col("_best.ms") < long * COVERED)
    fate = first_reason([("range", (F.col("start") < 0) | (F.col("end") > F.col("_ms")) | (long <= 0)), ("duration", ~long.between(SHORTEST_MS, LONGEST_MS)), ("overlap", lost)])
    return w.withColumn("fate", fate)


def fused(words: DataFrame, turns: DataFrame, durations: DataFrame, key: str, item: str) -> tuple[DataFrame, DataFrame]:
    """Segments under the speakers whose turns they lie in, and what was dropped why.

    ``words`` are ``(key, item, start, end, text)``, ``turns`` ``(key, start, end, speaker)``,
    ``durations`` ``(key, ms)``; times in ms.  Both sides are shifted by where speech begins.  The
    first table is ``(key, item, start, end, speaker, text)`` of kept segments, speakers numbered
    from 0 by the first kept segment in the order of ``item``; the second ``(key, kept,
    drop_overlap, drop_range, drop_duration, speakers)``.  Blank segments count for nothing.
    """
    all_ = _placed(words, turns, durations, key, item)
    kept = all_.where("fate = 'kept'").withColumn("_who", F.col("_best.speaker"))
    first = kept.groupBy(key, "_who").agg(F.min(item).alias("_first"))
    number = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).select(key, "_who", "_n")
    out = kept.join(number, [key, "_who"]).select(key, item, "start", "end", F.col("_n").alias("speaker"), "text")
    n = lambda f: F.count_if(F.col("fate") == f)
    counts = all_.groupBy(key).agg(n("kept").alias("kept"), n("overlap").alias("drop_overlap"), n("range").alias("drop_range"), n("duration").alias("drop_duration"), F.count_distinct(F.when(F.col("fate") == "kept", F.col("_best.speaker"))).alias("speakers"))
    return out, counts


def window_fate(rms: Column, segments: Column, seconds: float) -> Column:
    """Why a labelled window is no target, the first reason that holds, or ``kept``.

    ``segments`` are those of ``generated.marked_segments``: silent windows, texts without
    markers, markers over too little of the window, too few or too many letters a second, and
    letters that run in a loop.
    """
    covered = F.aggregate(segments, F.lit(0.0), lambda s, x: s + F.greatest(x["end"] - x["start"], F.lit(0.0)))
    said = F.array_join(F.transform(segments, lambda x: x["text"]), "")
    rate = F.length(said) / F.greatest(covered, F.lit(1e-6))
    letters = F.split(F.regexp_replace(said, r"(?U)\s+", ""), "")
    return first_reason([
        ("silent", rms < SILENT),
        ("no_structure", F.coalesce(F.size(segments), F.lit(0)) <= 0),
        ("low_coverage", covered / seconds < LEAST_COVERED),
        ("density", ~rate.between(LEAST_RATE, MOST_RATE)),
        ("loop", loops(letters, 3, REPEATS)),
    ])


def has_times(record: Column, path: str) -> Column:
    """Whether a JSON record's list at ``path`` has an item whose ``start`` is a number."""
    items = F.try_variant_get(F.try_parse_json(record), path, "array<variant>")
    kind = lambda x: F.schema_of_variant(F.coalesce(F.try_variant_get(x, "$.start", "variant"), F.parse_json(F.lit("null"))))
    return F.coalesce(F.exists(items, lambda x: kind(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")), F.lit(False))


def most_of_a_run(text: str, n: int) -> int:
    """How often the commonest run of ``n`` letters stands in a text, its last run left out."""
    if len(text) <= n:
        return 0
    _, rank = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True)
    width = 1
    while width < n:
        # runs of one width, by their ranks, give those of up to twice the width
        more = min(width, n - width)
        _, rank = np.unique(rank[: len(rank) - more] * len(text) + rank[more:], return_inverse=True)
        width += more
    return int(np.bincount(rank[: len(text) - n]).max())


def top_gram(text: Column, n: int) -> Column:
    """``most_of_a_run`` of each text; null counts as empty."""

    @F.arrow_udf("long")
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([most_of_a_run(t.as_py() or "", n) for t in texts], pa.int64())

    return batch(text)


def health(segments: DataFrame, key: str, n: int = 12) -> DataFrame:
    """``(key, markers, speakers, median_ms, max_repeat, dup_ratio, top_gram, chars, monotone)``.

    ``segments`` are ``(key, pos, start, end, speaker, text)``.  ``top_gram`` is how often the
    commonest run of ``n`` letters stands in the joined texts, the last run left out; runs are
    counted where the joined text is, and none of them is shuffled.
    """
    order = Window.partitionBy(key).orderBy("pos")
    s = segments.withColumn("_t", F.trim("text")).withColumn("_back", F.coalesce(F.col("start") < F.lag("start").over(order), F.lit(False)))
    per = s.groupBy(key).agg(
        F.count("*").alias("markers"), F.count_distinct("speaker").alias("speakers"), F.percentile(F.col("end") - F.col("start"), 0.5).alias("median_ms"), (~F.some("_back")).alias("monotone"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), "").alias("_said"),
    )
    texts = s.where("_t <> ''").groupBy(key, "_t").agg(F.count("*").alias("_k")).groupBy(key).agg(F.max("_k").alias("max_repeat"), F.count("*").alias("_kinds"), F.sum("_k").alias("_texts"))
    per = per.withColumn("top_gram", top_gram(F.col("_said"), n))
    out = per.join(texts, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    dup = F.coalesce(F.round(1 - F.col("_kinds") / F.col("_texts"), 3), F.lit(0.0))
    return out.select(key, "markers", "speakers", "median_ms", zero("max_repeat"), dup.alias("dup_ratio"), zero("top_gram"), F.length("_said").alias("chars"), "monotone")


def script_leak(raw: Column, converted: Column) -> Column:
    """``struct(cjk, changed)``: ideographs of a text, and those that another letter stands for in
    its conversion, place by place up to the shorter text's end."""
    both = F.filter(F.arrays_zip(F.split(raw, "").alias("a"), F.split(converted, "").alias("b")), lambda x: x["a"].between("一", "鿿") & (F.coalesce(x["b"], F.lit("")) != ""))
    return F.struct(F.size(both).cast("long").alias("cjk"), F.size(F.filter(both, lambda x: x["a"] != x["b"])).cast("long").alias("changed"))
