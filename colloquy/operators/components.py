"""Groups of what must be linked: connected components, and links from shared speaking time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.intervals import overlaps
from colloquy.operators.vectors import centroids
from colloquy.shared import Stages


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("low"))


def _mark(pairs: DataFrame) -> tuple:
    """Number and order-free checksum of the pairs."""
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` of all nodes that an edge names; component is the least node reachable.

    Nodes are of any type with an order, structs too.  Each round hands every node's larger
    neighbours to its least one, then every node and its smaller neighbours, until nothing
    moves; a round is minima and joins over the edges, so neither a hub nor a long chain is
    one task's work.  Edges with a null end are dropped; a loop names its node and links
    nothing.
    """
    stages = Stages()
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    loops = ends.where("a = b").select(F.col("a").alias("node")).distinct()
    pairs = stages.keep(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen = _mark(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _least_neighbour(both).withColumn("low", F.least("a", "low"))
        wide = stages.keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), "components")
        near = wide.join(_least_neighbour(wide), "a")
        down = near.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        new = stages.keep(near.select("a", F.col("low").alias("b")).unionByName(down).distinct(), "components")
        stages.drop(pairs, wide)
        pairs, now = new, _mark(new)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    alone = loops.join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))


def must_links(segments: DataFrame, key: str, window: int, step: int, least: int) -> DataFrame:
    """``(key, offset, a, b, shared)``: speakers of a window and of the next who speak at the same time.

    ``segments`` are ``(key, offset, speaker, start, end)`` in ms, with windows of ``window`` ms
    each ``step`` ms; ``a`` speaks in the window at ``offset``, ``b`` in the one after it.  Time
    counts inside what both windows cover; a pair is linked by more than ``least`` ms of it, added
    up over all pairs of their segments.
    """
    if step >= window:
        raise ValueError("neighbouring windows must overlap")

    def side(shift: int, name: str) -> DataFrame:
        at = F.col("offset") - shift  # of the earlier window
        s, e = F.greatest("start", at + step), F.least("end", at + window)
        return segments.select(key, at.alias("offset"), s.alias("start"), e.alias("end"), F.struct("speaker", "start", "end").alias(name)).where("start < end")

    both = overlaps(side(0, "a_id"), side(step, "b_id"), [key, "offset"], window)
    by = both.groupBy(key, "offset", F.col("a_id.speaker").alias("a"), F.col("b_id.speaker").alias("b")).agg(F.sum("overlap").alias("shared"))
    return by.where(F.col("shared") > least)


def linked_units(segments: DataFrame, key: str, window: int, step: int, least: int) -> DataFrame:
    """``(key, offset, speaker, first_offset, first_speaker)``: every unit with the first of its group.

    A unit is a speaker of a window; units linked through any number of windows are a group,
    named after its first unit.  A unit without a link is its own.
    """
    links = must_links(segments, key, window, step, least)
    unit = lambda at, who: F.struct(F.col(key).alias("key"), at.alias("offset"), F.col(who).alias("speaker"))
    edges = links.select(unit(F.col("offset"), "a").alias("a"), unit(F.col("offset") + step, "b").alias("b"))
    every = segments.select(unit(F.col("offset"), "speaker").alias("node")).distinct()
    got = every.join(connected(edges, "a", "b"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return got.select(
        F.col("node.key").alias(key), F.col("node.offset").alias("offset"), F.col("node.speaker").alias("speaker"),
        F.col("component.offset").alias("first_offset"), F.col("component.speaker").alias("first_speaker"),
    )


def group_means(units: DataFrame, vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, first_offset, first_speaker, centroid)``: the direction of a group's unit vectors."""
    named = vectors.join(units, [key, "offset", "speaker"])
    own = centroids(named.withColumn("_g", F.struct(key, "first_offset", "first_speaker")), "_g", vector)
    return own.select("_g.*", "centroid")
