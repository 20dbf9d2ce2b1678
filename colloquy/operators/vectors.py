"""Speaker-embedding analytics: norms, centroids, nearest centroid, average-link linking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(v: Column) -> Column:
    """The vector over its norm; zeros where the norm is below 1e-8 or not finite."""

    def scaled(n: Column) -> Column:
        ok = (n >= 1e-8) & ~F.isnan(n) & (n < float("inf"))
        return F.transform(v, lambda x: F.when(ok, x.cast("double") / n).otherwise(0.0))

    return once(F.sqrt(dot(v, v)), scaled)


def centroids(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """``(key, centroid)``: unit weighted sum of unit vectors; keys with no direction are left out."""
    w = weight if weight is not None else F.lit(1.0)
    long = rows.select(key, w.alias("_w"), F.posexplode(unit(F.col(vector))).alias("_k", "_x"))
    sums = long.groupBy(key, "_k").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    packed = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_v"))
    out = packed.select(key, unit(F.transform("_v", lambda x: x["_s"])).alias("centroid"))
    return out.where(F.exists("centroid", lambda x: x != 0))


def nearest(rows: DataFrame, vector: str, cents: DataFrame, key: str) -> DataFrame:
    """Adds ``nearest`` and ``similarity``; ties go to the smallest key.

    The centroids of one recording or label set are few and travel as one array; they are
    broadcast only if Spark finds them small.
    """
    packed = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("centroid").alias("c")))).alias("_c"))
    best = once(unit(F.col(vector)), lambda u: F.array_min(F.transform(F.col("_c"), lambda c: F.struct((-dot(u, c["c"])).alias("s"), c["k"].alias("k")))))
    return rows.crossJoin(packed).withColumn("_b", best).withColumns({"nearest": F.col("_b.k"), "similarity": -F.col("_b.s")}).drop("_b", "_c")


def average_link(x: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers by average linkage on cosine distance, cut at ``threshold``; numbers go by
    each cluster's first row."""
    from colloquy.operators.linkage import flat_clusters

    return flat_clusters(np.asarray(x), threshold)


def link_recording(seconds: np.ndarray, vectors: np.ndarray, threshold: float = 0.45, least_s: float = 3.0) -> list[str]:
    """Speaker labels S01, S02, ... of a recording's segments in order.

    Segments of ``least_s`` seconds or more are clustered, others go to the nearest centroid;
    one without an embedding (all zeros) takes the label before it.
    """
    has = np.linalg.norm(vectors, axis=1) > 0
    core = np.flatnonzero(has & (seconds >= least_s))
    label = np.full(len(vectors), -1)
    if len(core) >= 2:
        label[core] = average_link(vectors[core], threshold)
        kinds = list(dict.fromkeys(label[core]))
        means = np.array([vectors[core][label[core] == k].mean(axis=0) for k in kinds])
        means /= np.linalg.norm(means, axis=1, keepdims=True)
        rest = np.flatnonzero(has & (label < 0))
        label[rest] = np.array(kinds)[np.argmax(vectors[rest] @ means.T, axis=1)] if len(rest) else []
    else:
        label[has] = 0
    names: dict[int, str] = {}
    out, last = [], "S01"
    for k in label:
        if k >= 0:
            last = names.setdefault(int(k), f"S{len(names) + 1:02d}")
        out.append(last)
    return out


def link_speakers(rows: DataFrame, recording: str, order: str, seconds: str, vector: str) -> DataFrame:
    """``(recording, order, speaker)``: each recording is linked in its own task."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        x = np.array(pdf[vector].tolist(), np.float64)
        return pd.DataFrame({recording: pdf[recording], order: pdf[order], "speaker": link_recording(pdf[seconds].to_numpy(float), x)})

    kinds = dict(rows.dtypes)
    return rows.select(recording, order, seconds, vector).groupBy(recording).applyInPandas(
        run, f"{recording} {kinds[recording]}, {order} {kinds[order]}, speaker string"
    )
