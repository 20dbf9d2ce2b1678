"""Interval operators: islands, overlaps, windows, frames.  Times are whole milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Adds ``island``: rows of a key in time order, a new one where the gap to the latest end
    so far is ``gap`` or more."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(latest.isNull() | (F.col(start) - latest >= gap), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order)).drop("_opens")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bin_ms: int) -> DataFrame:
    """Pairs of intervals of a key that overlap, with ``overlap`` in ms.

    Both sides have ``start``, ``end`` and an id (``a_id``, ``b_id``).  Intervals are dealt to
    time bins and a pair is kept in the first bin the two share, so the join is an equi-join.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / bin_ms), F.floor(F.greatest(s, e - 1) / bin_ms)))
    left = a.select(*keys, "a_id", F.col("start").alias("s1"), F.col("end").alias("e1")).withColumn("_bin", bins(F.col("s1"), F.col("e1")))
    right = b.select(*keys, "b_id", F.col("start").alias("s2"), F.col("end").alias("e2")).withColumn("_bin", bins(F.col("s2"), F.col("e2")))
    both = left.join(right, [*keys, "_bin"]).where("s1 < e2 and s2 < e1")
    both = both.where(F.col("_bin") == F.floor(F.greatest("s1", "s2") / bin_ms))
    return both.withColumn("overlap", F.least("e1", "e2") - F.greatest("s1", "s2")).drop("_bin")


def hops(start: Column, size: int, step: int) -> Column:
    """First ms of every window of ``size`` ms, one each ``step`` ms from 0, that holds a time."""
    last = F.floor(start / step)
    first = F.greatest(F.floor((start - size) / step) + 1, F.lit(0))
    return F.transform(F.sequence(first, last), lambda k: k * step)


def frames(start: Column, end: Column, step: int) -> Column:
    """Frames whose centre the half-open interval covers; none for an empty interval."""
    half = step // 2
    first = F.ceil((start - half) / step)
    last = F.ceil((end - half) / step) - 1
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def sustained_start(rows: DataFrame, keys: list[str], time: str, within: int, least: int, lead: int) -> DataFrame:
    """Per key the first time with ``least`` times in [t, t + within), or where there is none the
    first time, less ``lead``, at least 0."""
    ahead = Window.partitionBy(*keys).orderBy(time).rangeBetween(0, within - 1)
    n = rows.withColumn("_n", F.count("*").over(ahead))
    return n.groupBy(*keys).agg(
        F.greatest(F.coalesce(F.min(F.when(F.col("_n") >= least, F.col(time))), F.min(time)) - lead, F.lit(0)).alias("start")
    )
