"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import drop_stage, stage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, int(row.h or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(node, component)``; component is the smallest reachable id.

    Large-star then small-star rounds until the edge set stands still.  Each step is a
    minimum with map-side combine and one join back, so a hub with very many neighbours is
    never gathered; every round is a table in the shared folder.  Loops and repeated edges
    are ignored; rows with a null end are dropped, as they link nothing.  No edges: no rows.
    """
    cur = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc"
    )
    seen = _mark(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "cc")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = (
            joined.select("a", F.col("m").alias("b"))
            .union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        small = stage(small, "cc")
        drop_stage(cur)
        drop_stage(large)
        cur, now = small, _mark(small)
        if now == seen:
            break
        seen = now
    return (
        cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .distinct()
    )
