"""Hierarchical clustering of each recording's vectors, kept so that every cut can be read off.

The merges are found by chains of nearest neighbours.  With average linkage on cosine distance
the mean distance of two clusters follows from the sums of their unit vectors, so no matrix of
distances is held.  Leaves are put in an order in which every cluster is a run; the height at
which a leaf's run meets the one before it says for any threshold where clusters end, so cuts
are window functions over all thresholds at once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _directions(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class _Average:
    """Mean cosine distances through sums of unit vectors: memory of the vectors only."""

    def __init__(self, unit: np.ndarray):
        self.sums, self.n = unit.copy(), np.ones(len(unit))

    def row(self, i: int) -> np.ndarray:
        return 1 - self.sums @ self.sums[i] / (self.n * self.n[i])

    def merge(self, i: int, j: int) -> None:
        self.sums[i] += self.sums[j]
        self.n[i] += self.n[j]


class _Matrix:
    """Complete and Ward linkage from a matrix of distances, updated at every merge."""

    def __init__(self, unit: np.ndarray, method: str):
        self.d, self.n, self.ward = 1 - unit @ unit.T, np.ones(len(unit)), method == "ward"

    def row(self, i: int) -> np.ndarray:
        return self.d[i]

    def merge(self, i: int, j: int) -> None:
        a, b, n = self.d[i], self.d[j], self.n
        if self.ward:
            square = ((n[i] + n) * a**2 + (n[j] + n) * b**2 - n * a[j] ** 2) / (n[i] + n[j] + n)
            new = np.sqrt(np.maximum(square, 0))
        else:
            new = np.maximum(a, b)
        self.d[i], self.d[:, i] = new, new
        n[i] += n[j]


def merge_steps(x: np.ndarray, method: str = "average") -> list[tuple[float, int, int]]:
    """``(height, a, b)`` of the n - 1 merges, lowest first; a and b are leaves of what merges."""
    unit = _directions(x)
    if method not in ("average", "complete", "ward"):
        raise ValueError(f"no such linkage: {method}")
    at = _Average(unit) if method == "average" else _Matrix(unit, method)
    gone, chain, out = np.zeros(len(unit), bool), [], []
    while len(out) < len(unit) - 1:
        if not chain:
            chain.append(int(np.argmin(gone)))
        c = chain[-1]
        d = np.where(gone, np.inf, at.row(c))
        d[c] = np.inf
        near = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[near]:  # each is the other's nearest
            i, j = sorted((c, chain[-2]))
            out.append((float(d[chain[-2]]), i, j))
            at.merge(i, j)
            gone[j] = True
            del chain[-2:]
        else:
            chain.append(near)
    return sorted(out, key=lambda m: m[0])


def leaf_order(n: int, steps: list[tuple[float, int, int]]) -> tuple[list[int], list[float]]:
    """Leaves so that every cluster is a run, and the height at which each meets the ones before.

    Of two clusters the one with the lowest leaf comes first; the first leaf has no height.
    """
    up, last, after, gap = list(range(n)), list(range(n)), [-1] * n, [float("inf")] * n

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for height, a, b in steps:
        a, b = sorted((find(a), find(b)))  # a cluster is named after its lowest leaf, its first
        up[b], after[last[a]], gap[b] = a, b, height
        last[a] = last[b]
    order, k = [], 0 if n else -1
    while k >= 0:
        order.append(k)
        k = after[k]
    return order, [gap[k] for k in order]


def flat_clusters(x: np.ndarray, threshold: float, method: str = "average") -> np.ndarray:
    """Cluster numbers of the rows at one threshold, in the order of each cluster's first row."""
    order, gaps = leaf_order(len(x), merge_steps(x, method))
    run = np.cumsum(np.array(gaps) > threshold)
    label = np.empty(len(x), np.int64)
    label[order] = run
    _, first, number = np.unique(label, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[number] if len(x) else label


def dendrogram(rows: DataFrame, recording: str, item: str, vector: str, method: str = "average") -> DataFrame:
    """``(recording, item, place, height)``: leaves in order; height is null for a recording's first.

    Vectors that are null, not finite or without direction are left out.  A recording's vectors
    are one task's work, of the square of their number in time; average linkage holds only
    the vectors, complete and Ward linkage the matrix of distances.
    """
    kinds = dict(rows.dtypes)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(item, ignore_index=True)
        order, gaps = leaf_order(len(pdf), merge_steps(np.array(pdf[vector].tolist(), float), method))
        got = pdf.iloc[order]
        heights = [None if g == float("inf") else g for g in gaps]
        return pd.DataFrame({recording: got[recording].to_numpy(), item: got[item].to_numpy(), "place": range(len(got)), "height": pd.Series(heights, dtype="float64")})

    return _known(rows, recording, item, vector).groupBy(recording).applyInPandas(run, f"{recording} {kinds[recording]}, {item} {kinds[item]}, place int, height double")


def _known(rows: DataFrame, recording: str, item: str, vector: str) -> DataFrame:
    """Items whose vectors have a direction."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: F.abs(x) > 1e-12)
    return rows.select(recording, item, v.alias(vector)).where(F.coalesce(fine, F.lit(False)))


def swept_clusters(rows: DataFrame, recording: str, item: str, vector: str, method: str, thresholds: list[float]) -> DataFrame:
    """``(recording, item, clusters)``: one row an item with its cluster at every threshold, numbered
    as by ``cuts`` of its ``dendrogram``."""
    kinds = dict(rows.dtypes)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(item, ignore_index=True)
        order, gaps = leaf_order(len(pdf), merge_steps(np.array(pdf[vector].tolist(), float), method))
        found = np.empty((len(pdf), len(thresholds)), np.int32)
        for k, t in enumerate(thresholds):
            label = np.empty(len(pdf), np.int64)
            label[order] = np.cumsum(np.array(gaps) > t)
            _, first, number = np.unique(label, return_index=True, return_inverse=True)
            found[:, k] = np.argsort(np.argsort(first))[number] + 1
        return pd.DataFrame({recording: pdf[recording], item: pdf[item], "clusters": list(found)})

    return _known(rows, recording, item, vector).groupBy(recording).applyInPandas(run, f"{recording} {kinds[recording]}, {item} {kinds[item]}, clusters array<int>")


def cuts(tree: DataFrame, recording: str, item: str, thresholds: list[float]) -> DataFrame:
    """``(recording, threshold, item, cluster)``: a tree cut at every threshold, clusters from 1 in
    the order of their first item."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    rows = tree.select(recording, item, "place", "height", at)
    opens = F.when(F.col("height") <= F.col("threshold"), 0).otherwise(1)  # null: the first leaf
    return numbered(rows.withColumn("_run", F.sum(opens).over(Window.partitionBy(recording, "threshold").orderBy("place"))), [recording, "threshold"], item)


def numbered(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """``(keys, item, cluster)``: the runs ``_run`` numbered from 1 by their first items."""
    first = F.min(item).over(Window.partitionBy(*keys, "_run"))
    return rows.withColumn("_first", first).select(*keys, item, F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first")).alias("cluster"))


def cut_into(tree: DataFrame, recording: str, item: str, wanted: DataFrame) -> DataFrame:
    """``(recording, item, cluster)``: at most ``wanted(recording, k)`` clusters, as many as heights allow.

    Clusters end where the height is above the k-th greatest; of equal heights none or all.
    """
    by_height = Window.partitionBy(recording).orderBy(F.desc_nulls_last("height"))
    ranked = tree.join(wanted.select(recording, F.col("k").alias("_k")), recording)
    limit = F.max(F.when(F.col("_rank") == F.col("_k"), F.col("height"))).over(Window.partitionBy(recording))
    ranked = ranked.withColumn("_rank", F.row_number().over(by_height)).withColumn("_limit", limit)
    # no k-th height: fewer merges than k, and every leaf stands alone
    opens = F.when(F.col("height").isNull() | F.col("_limit").isNull() | (F.col("height") > F.col("_limit")), 1).otherwise(0)
    return numbered(ranked.withColumn("_run", F.sum(opens).over(Window.partitionBy(recording).orderBy("place"))), [recording], item)


def swept_segments(segments: DataFrame, units: DataFrame, recording: str, order: str, unit: list[str], method: str, thresholds: list[float], keep: list[str] = ()) -> DataFrame:
    """``(recording, threshold, order, *keep, speaker)``: segments under the labels of their units' clusters.

    ``units`` hold ``(recording, *unit, vector)``; with ``unit`` the segment's own place every
    segment is clustered by itself, with window and speaker by its pooled vector.  Labels S01,
    S02, .. go by first appearance; a segment whose unit has no vector takes the label before
    it, S01 at the start.
    """
    named = segments.withColumn("_unit", F.struct(*unit))
    first = named.groupBy(recording, "_unit").agg(F.min(order).alias("_item"))
    placed = units.withColumn("_unit", F.struct(*unit)).join(first, [recording, "_unit"]).select(recording, "_item", "vector")
    got = swept_clusters(placed, recording, "_item", "vector", method, thresholds)
    found = named.join(first, [recording, "_unit"]).select(recording, order, *keep, "_item").join(got, [recording, "_item"], "left")
    # a unit without a vector has no cluster at any threshold, so all are filled at once
    before = Window.partitionBy(recording).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = found.withColumn("_c", F.coalesce(F.last("clusters", True).over(before), F.array_repeat(F.lit(1), len(thresholds))))
    each = F.explode(F.arrays_zip(F.array(*(F.lit(float(t)) for t in thresholds)).alias("t"), F.col("_c").alias("c"))).alias("_e")
    rows = filled.select(recording, order, *keep, each)
    return rows.select(recording, F.col("_e.t").alias("threshold"), order, *keep, F.format_string("S%02d", F.col("_e.c")).alias("speaker"))


def global_speakers(segments: DataFrame, recording: str, order: str, seconds: str, vector: str, threshold: float = 0.7, least_s: float = 0.3) -> DataFrame:
    """Segments under the speakers of the whole recording, S01 first to speak; ``speaker`` is replaced.

    Segments shorter than ``least_s`` or without a vector are dropped; a recording with fewer
    than two others keeps all of its segments as they are.
    """
    voiced = segments.where(F.col(seconds) >= least_s)
    tree = dendrogram(voiced, recording, order, vector)
    n = tree.groupBy(recording).agg(F.count("*").alias("_n"))
    found = cuts(tree, recording, order, [threshold]).select(recording, order, F.format_string("S%02d", "cluster").alias("_who"))
    got = segments.join(n, recording, "left").join(found, [recording, order], "left")
    few = F.coalesce(F.col("_n"), F.lit(0)) < 2
    kept = got.where(few | F.col("_who").isNotNull())
    return kept.withColumn("speaker", F.when(few, F.col("speaker")).otherwise(F.col("_who"))).select(*segments.columns)
