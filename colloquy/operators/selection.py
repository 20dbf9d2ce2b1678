"""Choosing rows: budgets, splits, ladders of reasons, decontamination, last writer wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.shared import Stages


def running(rows: DataFrame, keys: list[str], order: list[Column], cost: str | None = None) -> DataFrame:
    """Adds ``_place`` (from 1), ``_n`` (rows of the key) and ``_before`` (cost of the rows before) in order.

    Rows are dealt by ranges of key and order, so a key that holds most of the table is many
    tasks' work; what the ranges before hold is added from their totals, one row a range and key.
    A null cost counts as none.  ``order`` must tell a key's rows apart.
    """
    names = [f"_o{k}" for k in range(len(order))]
    ordered = rows.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)))
    ranged = ordered.repartitionByRange(*keys, *names).withColumn("_range", F.spark_partition_id())
    # a range that is worked out again might be cut elsewhere, so it is written down
    dealt = Stages().keep(ranged, "ranges")
    spent = F.coalesce(F.col(cost), F.lit(0)) if cost else F.lit(0)
    totals = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"), F.sum(spent).alias("_spent"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(
        *keys, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_r"), F.coalesce(F.sum("_spent").over(earlier), F.lit(0)).alias("_s"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_n"),
    )
    named = sums.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_range")})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_range")]
    whole = dealt.join(named, same, "left")
    own = Window.partitionBy(*keys, "_range").orderBy(*names)
    before = F.coalesce(F.sum(spent).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = whole.withColumns({"_place": F.row_number().over(own) + F.col("_r"), "_before": before + F.col("_s")})
    return out.select(*rows.columns, "_place", "_n", "_before")


def within_budget(rows: DataFrame, keys: list[str], cost: str, order: list[Column], budget: float) -> DataFrame:
    """Rows of each key while what came before costs less than the budget; the crossing row stays."""
    return running(rows, keys, order, cost).where(F.col("_before") < budget).select(*rows.columns)


def split_rows(rows: DataFrame, keys: list[str], order: list[Column], percent: int) -> DataFrame:
    """Adds ``split``: ``val`` for the first max(1, round-half-even(percent)) rows of a key, else ``train``."""
    first = F.greatest(F.bround(F.col("_n") * percent / 100).cast("int"), F.lit(1))
    return running(rows, keys, order).select(*rows.columns, F.when(F.col("_place") <= first, "val").otherwise("train").alias("split"))


def top(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def first_reason(ladder: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    """The name of the first condition that holds."""
    out = F.when(ladder[0][1], ladder[0][0])
    for name, cond in ladder[1:]:
        out = out.when(cond, name)
    return out.otherwise(otherwise)


#: Passages of one or two words, which have no whole word inside, that are compared with every text.
MOST_SHORT = 10_000


def containing(docs: DataFrame, passages: DataFrame, doc_id: str, text: str, passage: str, most_short: int = MOST_SHORT) -> DataFrame:
    """Ids of documents that hold a whole passage as a substring.

    The words of a passage between its first and last are whole words of any text that holds it;
    texts are found by such runs, of five words at most, and then compared exactly.  Passages
    of one or two words are compared with every text; more than ``most_short`` of them are
    refused, as they travel to every task.
    """
    inner = F.split(F.col("p"), r"\s+")
    run = F.least(F.size(inner) - 2, F.lit(5))
    p = passages.select(F.col(passage).alias("p")).where("p is not null").distinct().withColumn("n", run)
    long = p.where("n > 0").select("p", F.array_join(F.slice(inner, 2, F.col("n")), " ").alias("key"))
    sizes = [r.n for r in p.where("n > 0").select("n").distinct().collect()]  # five at most
    few = [r.p for r in p.where("n <= 0").select("p").limit(most_short + 1).collect()]
    if len(few) > most_short:
        raise ValueError(f"more than {most_short} passages of one or two words")
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).where("t is not null")
    out = d.where(F.exists(F.array(*map(F.lit, few)), lambda x: F.contains(F.col("t"), x))).select("id") if few else d.select("id").limit(0)
    if sizes:
        def runs_of(words: Column, k: int) -> Column:
            last = F.slice(words, k, F.greatest(F.size(words) - k + 1, F.lit(0)))
            return F.transform(last, lambda w, i: F.array_join(F.slice(words, i + 1, k), " "))

        # the words are bound once: a lambda that split the text itself would do so for every word
        runs = lambda words: F.flatten(F.array(*(runs_of(words, k) for k in sizes)))
        keys = F.array_distinct(F.flatten(F.transform(F.array(F.split(F.col("t"), r"\s+")), runs)))
        hits = d.select("id", F.explode(keys).alias("key")).join(long, "key").select("id", "p").distinct()
        out = out.unionByName(d.join(hits, "id").where(F.contains("t", "p")).select("id"))
    return out.distinct()


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top(rows, keys, [o.desc() for o in order], 1)
