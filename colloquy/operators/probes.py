"""Two models' logits compared: divergence, agreement and margins, over rows cut into parts.

A row of logits is any number of parts ``(row, first, teacher, candidate)`` of its vocabulary.
Each part is reduced to its maximum and to sums scaled by it; parts merge by scaling the smaller
maximum's sums down, so no exponential overflows and a vocabulary of any size needs no row of
its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _scaled(part: Column, other: Column, of: Column) -> Column:
    """Maximum, sum of exponentials below it, and that sum weighted by the difference to ``other``."""
    weights = F.transform(part, lambda x: F.exp(x - of))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return F.struct(of.alias("m"), total(weights).alias("s"), total(F.zip_with(weights, F.zip_with(part, other, lambda t, c: t - c), lambda w, d: w * d)).alias("w"))


def _merged(parts: Column) -> Column:
    """Parts of ``_scaled`` as one."""
    top = F.array_max(F.transform(parts, lambda p: p["m"]))
    total = lambda name: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p[name] * F.exp(p["m"] - top))
    return F.struct(top.alias("m"), total("s").alias("s"), total("w").alias("w"))


def _two_best(parts: Column) -> Column:
    """The two greatest of parts' two greatest values, with their places; ties: the lower place first."""
    return F.slice(F.array_sort(F.flatten(parts)), 1, 2)


def compared(logits: DataFrame, keys: list[str], first: str, teacher: str, candidate: str) -> DataFrame:
    """``(keys, kl, best, margin)``: of each row, over its whole vocabulary.

    ``kl`` is the divergence of the candidate's distribution from the teacher's, ``best`` the
    place of the candidate's greatest logit (the lowest of equals) and ``margin`` how far it is
    above the next, null in a vocabulary of one.  Parts must not overlap and hold no nulls.
    """
    t, c = F.col(teacher).cast("array<double>"), F.col(candidate).cast("array<double>")
    placed = lambda xs: F.transform(xs, lambda x, i: F.struct((-x).alias("v"), (F.col(first) + i).alias("at")))
    zero = F.transform(c, lambda x: x)
    parts = logits.where(F.size(teacher) > 0).select(
        *keys, _scaled(t, c, F.array_max(t)).alias("t"), _scaled(c, zero, F.array_max(c)).alias("c"), F.slice(F.array_sort(placed(c)), 1, 2).alias("b")
    )
    # a row has as many parts as its vocabulary was cut into
    whole = parts.groupBy(*keys).agg(F.collect_list("t").alias("t"), F.collect_list("c").alias("c"), F.collect_list("b").alias("b"))
    got = whole.select(*keys, _merged(F.col("t")).alias("t"), _merged(F.col("c")).alias("c"), _two_best(F.col("b")).alias("b"))
    lse = lambda x: F.col(f"{x}.m") + F.log(F.col(f"{x}.s"))
    kl = F.col("t.w") / F.col("t.s") - lse("t") + lse("c")
    b = lambda k: F.get("b", F.lit(k))
    return got.select(*keys, kl.alias("kl"), b(0)["at"].alias("best"), (b(1)["v"] - b(0)["v"]).alias("margin"))


def probe_report(rows: DataFrame, key: str, forced: str, special: Column) -> DataFrame:
    """``(key, kl, agree, s_margin, s_agree)`` over ``compared`` rows with the token that was forced.

    Agreement is in percent; the last two are over rows where ``special`` holds, null without one.
    """
    hit = F.when(F.col("best") == F.col(forced), 100.0).otherwise(0.0)
    return rows.groupBy(key).agg(
        F.round(F.avg("kl"), 4).alias("kl"), F.round(F.avg(hit), 2).alias("agree"), F.round(F.avg(F.when(special, F.col("margin"))), 3).alias("s_margin"), F.round(F.avg(F.when(special, hit)), 2).alias("s_agree")
    )


def boundary_margins(logits: DataFrame, keys: list[str], first: str, values: str, gold: str, boundary: int) -> DataFrame:
    """``(keys, positive, margin)``: how sure a model is of a boundary token, and of others against it.

    Where the gold token is the boundary, its logit less the greatest of all others; elsewhere
    the gold token's logit less the boundary's.
    """
    v, at = F.col(values).cast("array<double>"), F.col(first)
    one = lambda place: F.get(v, (place - at).cast("int"))  # noqa: E731  null outside of the part
    inside = lambda place: F.when((place >= at) & (place < at + F.size(v)), one(place))
    others = F.array_max(F.filter(v, lambda x, i: at + i != boundary))
    parts = logits.groupBy(*keys).agg(
        F.max(gold).alias("_gold"), F.max(inside(F.lit(boundary))).alias("_edge"), F.max(inside(F.col(gold))).alias("_own"), F.max(others).alias("_rest")
    )
    positive = F.col("_gold") == boundary
    return parts.select(*keys, positive.alias("positive"), F.when(positive, F.col("_edge") - F.col("_rest")).otherwise(F.col("_own") - F.col("_edge")).alias("margin"))


def margin_report(margins: DataFrame, key: str) -> DataFrame:
    """``(key, positive, n, median, narrow)``: median margin and how many are under one half."""
    return margins.groupBy(key, "positive").agg(F.count("*").alias("n"), F.round(F.percentile("margin", 0.5), 6).alias("median"), F.count_if(F.col("margin") < 0.5).alias("narrow"))
