"""Transcript metrics: error rates, diarization error, consistency, timestamps, gates.

Per frame, missed + false + confused speech is the larger number of speakers less the
correctly mapped ones, and a one-to-one map never maps more than the smaller number.  So the
diarization error rate and the consistency need only counts by frame and the best total
overlap of an assignment, which both come from grouped aggregates; only the small speaker
matrix of a recording is solved in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.edits import edit_distance, rate
from colloquy.functions.text import tokens
from colloquy.operators.intervals import islands, overlaps
from colloquy.operators.matching import assign
from colloquy.shared import Stages


def last_of_each(hyp: DataFrame, key: str, order: str) -> DataFrame:
    """Of several hypotheses of a key the last in ``order``."""
    own = F.struct(*hyp.columns)
    return hyp.groupBy(key).agg(F.max_by(own, order).alias("_h")).select("_h.*")


def paired(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """``(n_records, n_missing)``: reference rows, and those whose key no hypothesis has."""
    heard = hyp.select(key).distinct().withColumn("_heard", F.lit(1))
    n = ref.select(key).join(heard, key, "left")
    return n.agg(F.count("*").alias("n_records"), F.count_if(F.col("_heard").isNull()).alias("n_missing"))


def mixed_error_rate(ref: DataFrame, hyp: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``(key, edits, n_ref, n_hyp, mer)`` of every row of ref.

    Of several hypotheses of a key the last in ``order`` counts; without an order hyp must have
    one row a key.  A key without a hypothesis is scored against nothing; one without a
    reference is left out.
    """
    r = ref.select(key, tokens(F.col("text")).alias("r"))
    h = (last_of_each(hyp, key, order) if order else hyp).select(key, tokens(F.col("text")).alias("h"))
    none = F.array().cast("array<string>")
    both = r.join(h, key, "left").withColumn("h", F.coalesce("h", none))
    d = both.select(key, edit_distance(F.col("r"), F.col("h")).alias("edits"), F.size("r").alias("n_ref"), F.size("h").alias("n_hyp"))
    return d.withColumn("mer", rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp")))


def _streams(segments: DataFrame, key: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "pos", "text"))), lambda x: x["text"]), " ")
    return segments.groupBy(key, "speaker").agg(text.alias("text"))


def _matrix(pairs: list[dict]) -> tuple[np.ndarray, list, list]:
    """Sums of ``v`` by ``a`` and ``b``, and what the rows and columns are, in order."""
    known = [p for p in pairs if p["a"] is not None and p["b"] is not None]
    a, b = (sorted({p[c] for p in known}) for c in "ab")
    row, col = ({x: k for k, x in enumerate(side)} for side in (a, b))
    m = np.zeros((len(a), len(b)))
    for p in known:
        m[row[p["a"]], col[p["b"]]] += p["v"] or 0
    return m, a, b


def _by_key(pairs: DataFrame, key: str, value: str, found) -> DataFrame:
    """``(key, _x)``: what ``found`` makes of each key's pairs, many keys a batch."""
    return pairs.groupBy(key).agg(F.collect_list(F.struct("a", "b", F.col(value).alias("v"))).alias("_p")).select(key, found(F.col("_p")).alias("_x"))


def best_total(pairs: DataFrame, key: str, value: str, largest: bool, name: str) -> DataFrame:
    """The best total of a one-to-one map between ``a`` and ``b`` of each key."""

    @F.arrow_udf("double")
    def found(pairs: pa.Array) -> pa.Array:
        every = (_matrix(p.as_py())[0] for p in pairs)
        return pa.array([float(sum(m[r, c] for r, c in assign(-m if largest else m))) for m in every], pa.float64())

    return _by_key(pairs, key, value, found).withColumnRenamed("_x", name)


def cpwer(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """Permutation-minimised error rate: speakers' token streams matched for least edits.

    All pairs of a recording's speakers are scored in parallel; streams without a partner are
    matched with nothing.
    """
    r = _streams(ref, key).select(key, F.col("speaker").alias("a"), tokens(F.col("text")).alias("r"))
    h = _streams(hyp, key).select(key, F.col("speaker").alias("b"), tokens(F.col("text")).alias("h"))
    n = r.groupBy(key).agg(F.sum(F.size("r")).alias("n_ref"), F.count("*").alias("n_r")).join(
        h.groupBy(key).agg(F.sum(F.size("h")).alias("n_hyp"), F.count("*").alias("n_h")), key, "left"
    ).na.fill(0)
    none = F.array().cast("array<string>")
    # empty streams fill the smaller side up
    pad = lambda side, more, name, col: n.where(more > 0).select(key, F.explode(F.sequence(F.lit(1), more)).alias("_pad")).select(
        key, F.concat(F.lit("\u0000"), "_pad").alias(name), none.alias(col)
    )
    r2 = r.union(pad(r, F.col("n_h") - F.col("n_r"), "a", "r"))
    h2 = h.union(pad(h, F.col("n_r") - F.col("n_h"), "b", "h"))
    cost = r2.join(h2, key).select(key, "a", "b", edit_distance(F.col("r"), F.col("h")).alias("edits"))
    best = best_total(cost, key, "edits", False, "edits")
    return n.join(best, key, "left").select(
        key, F.coalesce("edits", F.lit(0.0)).alias("edits"), "n_ref", "n_hyp",
        rate(F.coalesce("edits", F.lit(0.0)), F.col("n_ref"), F.col("n_hyp")).alias("cpwer"),
    )


def frame_ranges(segments: DataFrame, key: str, step: int) -> DataFrame:
    """``(key, speaker, start, end)``: runs of frames of ``step`` ms whose centre a speaker's
    segments cover, from the first to before the last; runs that meet are one."""
    half = step // 2
    at = lambda t: F.ceil((F.col(t) - half) / step).cast("long").alias(t)
    rows = segments.select(key, "speaker", at("start"), at("end")).where("start < end")
    runs = islands(rows, [key, "speaker"], "start", "end", 1)
    return runs.groupBy(key, "speaker", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _swept(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Stretches between neighbouring edges of a key: frames and how many runs of each side hold."""
    edges = None
    for name, runs in sides.items():
        for at, sign in (("start", 1), ("end", -1)):
            new = runs.select(key, F.col(at).alias("at"), *(F.lit(sign if n == name else 0).alias(n) for n in sides))
            edges = new if edges is None else edges.union(new)
    order = Window.partitionBy(key).orderBy("at")
    by = edges.groupBy(key, "at").agg(*(F.sum(n).alias(n) for n in sides))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return by.select(key, *(F.sum(n).over(upto).alias(n) for n in sides), (F.lead("at").over(order) - F.col("at")).alias("frames")).where("frames > 0")


#: Frames of a bin in which runs of two speakers meet.
_BIN = 6000


def speaker_errors(ref: DataFrame, hyp: DataFrame, key: str, step: int = 10, collar: int = 250) -> DataFrame:
    """``(key, ref_frames, hyp_frames, der, consistency)`` per recording of the reference.

    Frames of ``step`` ms are counted by stretches between edges of segments, never one by
    one.  The collar takes frames whose centre lies less than ``collar`` ms from a reference
    boundary out of the error rate, not out of the consistency.
    """
    half = step // 2
    r, h = frame_ranges(ref, key, step), frame_ranges(hyp, key, step)
    edge = ref.select(key, F.explode(F.array("start", "end")).alias("at"))
    near = edge.select(
        key,
        F.lit("").alias("speaker"),
        (F.floor((F.col("at") - collar - half) / step) + 1).alias("start"),
        F.ceil((F.col("at") + collar - half) / step).cast("long").alias("end"),
    ).where("start < end")
    merged = islands(near, [key], "start", "end", 1).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    s = _swept({"nr": r, "nh": h, "nc": merged}, key)
    inside = F.when(F.col("nc") == 0, F.col("frames")).otherwise(0)
    total = s.groupBy(key).agg(
        F.sum(F.col("nr") * F.col("frames")).alias("ref_frames"),
        F.sum(F.col("nh") * F.col("frames")).alias("hyp_frames"),
        F.sum(F.col("nr") * inside).alias("_nr"),
        F.sum(F.col("nh") * inside).alias("_nh"),
        F.sum(F.greatest("nr", "nh") * inside).alias("_most"),
    )
    both = overlaps(r.withColumnRenamed("speaker", "a_id"), h.withColumnRenamed("speaker", "b_id"), [key], _BIN)
    both = both.select(key, F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.greatest("s1", "s2").alias("start"), F.least("e1", "e2").alias("end"), "overlap")
    cut = overlaps(both.withColumn("a_id", F.struct("a", "b")), merged.withColumn("b_id", F.lit(0)), [key], _BIN)
    lost = cut.groupBy(key, F.col("a_id.a").alias("a"), F.col("a_id.b").alias("b")).agg(F.sum("overlap").alias("lost"))
    pairs = both.groupBy(key, "a", "b").agg(F.sum("overlap").alias("n")).join(lost, [key, "a", "b"], "left")
    pairs = pairs.withColumn("inner", F.col("n") - F.coalesce("lost", F.lit(0)))
    z = ref.select(key).distinct().join(total, key, "left")
    z = z.join(best_total(pairs, key, "n", True, "_best"), key, "left").join(best_total(pairs, key, "inner", True, "_inner"), key, "left").na.fill(0)
    return z.select(
        key, "ref_frames", "hyp_frames",
        F.when(F.col("_nr") == 0, F.when(F.col("_nh") == 0, 0.0).otherwise(1.0)).otherwise((F.col("_most") - F.col("_inner")) / F.col("_nr")).alias("der"),
        F.when(F.col("hyp_frames") == 0, 1.0).when(F.col("ref_frames") == 0, 0.0).otherwise(F.col("_best") / F.col("hyp_frames")).alias("consistency"),
    )


def speaker_map(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """``(key, speaker, mapped)``: hypothesis speakers to the reference speakers they share most time with.

    One to one and of greatest total overlap; a speaker who shares nothing has no row.
    """
    cols = [key, "start", "end"]
    o = overlaps(ref.select(*cols, F.col("speaker").alias("a_id")), hyp.select(*cols, F.col("speaker").alias("b_id")), [key], 60_000)
    pairs = o.groupBy(key, F.col("a_id").alias("a"), F.col("b_id").alias("b")).agg(F.sum("overlap").alias("n"))

    @F.arrow_udf("array<struct<speaker: string, mapped: string>>")
    def found(pairs: pa.Array) -> pa.Array:
        out = []
        for p in pairs:
            m, a, b = _matrix(p.as_py())
            out.append([{"speaker": b[c], "mapped": a[r]} for r, c in assign(-m) if m[r, c] > 0])
        return pa.array(out, pa.list_(pa.struct([("speaker", pa.string()), ("mapped", pa.string())])))

    return _by_key(pairs, key, "n", found).select(key, F.explode("_x").alias("_x")).select(key, "_x.*")


def timestamp_error(ref: DataFrame, hyp: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """``(key, matched, unmatched, mae_ms)``: mean of start and end differences of greedy pairs.

    Hypothesis speakers are mapped to reference speakers first.  Segments may pair if their
    speakers are the same and their token sets more than ``least`` alike; candidates are found
    by a shared token (or by having none), and only those above ``least`` reach the greedy
    choice of a recording.
    """
    names = speaker_map(ref, hyp, key)
    h = hyp.join(names, [key, "speaker"], "left").withColumn("speaker", F.coalesce("mapped", F.concat(F.lit("\u0000"), "speaker"))).drop("mapped")

    def side(rows: DataFrame, tag: str) -> DataFrame:
        words = F.array_sort(F.array_distinct(tokens(F.col("text"))))
        return rows.select(key, "speaker", F.col("pos").alias(f"pos_{tag}"), F.col("start").alias(f"s_{tag}"), F.col("end").alias(f"e_{tag}"), words.alias(f"w_{tag}"))

    a, b = side(ref, "a"), side(h, "b")
    by_word = lambda x, w: x.withColumn("_w", F.explode(F.when(F.size(w) > 0, F.col(w)).otherwise(F.array(F.lit("")))))
    shared = by_word(a, "w_a").select(key, "speaker", "_w", "pos_a", F.size("w_a").alias("n_a")).join(
        by_word(b, "w_b").select(key, "speaker", "_w", "pos_b", F.size("w_b").alias("n_b")), [key, "speaker", "_w"]
    )
    both = shared.groupBy(key, "pos_a", "pos_b").agg(F.count("*").alias("n"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    score = F.when(F.col("n_a") + F.col("n_b") == 0, 1.0).otherwise(F.col("n") / F.greatest(F.col("n_a") + F.col("n_b") - F.col("n"), F.lit(1)))
    near = both.withColumn("score", score).where(F.col("score") > least)
    near = near.join(a.select(key, "pos_a", "s_a", "e_a"), [key, "pos_a"]).join(b.select(key, "pos_b", "s_b", "e_b"), [key, "pos_b"])

    @F.arrow_udf("struct<matched: long, mae_ms: double>")
    def chosen(candidates: pa.Array) -> pa.Array:
        out = []
        for c in candidates:
            rows, cols, gaps = set(), set(), []
            for x in sorted(c.as_py(), key=lambda x: (-x["score"], abs(x["s_a"] - x["s_b"]), x["pos_a"], x["pos_b"])):
                if x["pos_a"] not in rows and x["pos_b"] not in cols:
                    rows.add(x["pos_a"])
                    cols.add(x["pos_b"])
                    gaps += [abs(x["s_a"] - x["s_b"]), abs(x["e_a"] - x["e_b"])]
            out.append({"matched": len(rows), "mae_ms": float(np.mean(gaps))})
        return pa.array(out, pa.struct([("matched", pa.int64()), ("mae_ms", pa.float64())]))

    held = near.groupBy(key).agg(F.collect_list(F.struct("score", "pos_a", "pos_b", "s_a", "s_b", "e_a", "e_b")).alias("_c"))
    got = held.select(key, chosen(F.col("_c")).alias("_x")).select(key, "_x.*")
    n = ref.groupBy(key).agg(F.count("*").alias("n")).join(got, key, "left").na.fill(0)
    return n.select(key, "matched", (F.col("n") - F.col("matched")).alias("unmatched"), "mae_ms")


def weight_of(column: str):
    """A weight that is not positive counts as 1."""
    return F.when(F.col(column) > 0, F.col(column)).otherwise(1.0)


def gate(metrics: DataFrame, slices: list[str], value: str, weight: str, limit: float) -> DataFrame:
    """Weighted means of a metric over all rows and each slice, and whether they pass.

    ``overall`` tells the total from a slice without a name.  Means above the limit fail, and
    so does a slice without a value.
    """
    w = weight_of(weight)
    by = metrics.withColumn("_w", w).rollup(*slices).agg(
        (F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("mean"), F.count("*").alias("n"), (F.grouping(slices[0]) == 1).alias("overall")
    )
    return by.withColumn("passed", F.coalesce(F.col("mean") <= limit, F.lit(False)))


def record_metrics(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """``(key, mer, cpwer, der, timestamp_mae, unmatched)`` of each reference recording.

    Where nothing is heard the rates are at their worst, but the timestamp error, a mean over
    matched segments, is 0: ``unmatched`` tells how many segments have none.
    """
    stages = Stages()  # both sides are read by four metrics
    ref, hyp = stages.keep(ref, "gates-ref"), stages.keep(hyp, "gates-hyp")
    one = lambda s: s.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "pos", "text"))), lambda x: x["text"]), " ").alias("text"))
    out = mixed_error_rate(one(ref), one(hyp), key).select(key, "mer")
    out = out.join(cpwer(ref, hyp, key).select(key, "cpwer"), key, "left")
    out = out.join(speaker_errors(ref, hyp, key).select(key, "der"), key, "left")
    return out.join(timestamp_error(ref, hyp, key).select(key, (F.col("mae_ms") / 1000).alias("timestamp_mae"), "unmatched"), key, "left")


def run_gates(metrics: DataFrame, limits: dict[str, float], weight: str, slice_col: str) -> DataFrame:
    """``(gate, value, limit, n, passed)`` of each threshold.

    A threshold is named after a metric, or ``<slice>_<metric>`` for the rows of one slice; a
    slice that no row has is left out.  Values are weighted means.  Without any row every
    overall gate fails.
    """
    named = sorted((c for c in metrics.columns if c not in (weight, slice_col)), key=len, reverse=True)
    rules = []
    for name, limit in limits.items():
        metric = next((m for m in named if name == m or name.endswith("_" + m)), None)
        if metric:
            rules.append((name, metric, None if name == metric else name[: -len(metric) - 1], float(limit)))
    spark = metrics.sparkSession
    table = spark.createDataFrame(rules, "gate string, metric string, slice string, limit double")
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in named)))
    long = metrics.select(weight_of(weight).alias("_w"), F.col(slice_col).alias("_s"), values.alias("x")).select("_w", "_s", "x.*")
    # the rules are the caller's and few, whatever the metrics
    hit = long.join(F.broadcast(table), "metric").where("slice is null or slice = _s")
    by = hit.groupBy("gate").agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("value"), F.count("*").alias("n"))
    out = table.join(by, "gate", "left").where("slice is null or n > 0")
    return out.select("gate", "value", "limit", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("value") <= F.col("limit"), F.lit(False)).alias("passed"))
