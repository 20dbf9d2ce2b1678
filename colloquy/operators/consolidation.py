"""Speakers of a finished recording put together: by their means, or segment by segment."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.vectors import average_link, unit


def id_order(label: str) -> tuple[float, str]:
    """Labels by the number at their end; those without one come last, by name."""
    digits = re.search(r"[0-9]+$", label)
    return (float(digits[0]) if digits else float("inf"), label)


def speaker_means(store: DataFrame, recording: str, speaker: str, vector: str) -> DataFrame:
    """``(recording, speaker, n, mean)``: direction of the sum of a speaker's vectors; none: left out."""
    rows = store.select(recording, speaker, F.posexplode(vector).alias("_k", "_x"))
    sums = rows.groupBy(recording, speaker, "_k").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    packed = sums.groupBy(recording, speaker).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_k", "_s"))).alias("_v"))
    out = packed.select(recording, speaker, "n", unit(F.transform("_v", lambda x: x["_s"])).alias("mean"))
    return out.where(F.exists("mean", lambda x: x != 0))


def merged_names(names: list[str], counts: np.ndarray, means: np.ndarray, threshold: float = 0.45, least: int = 3) -> dict[str, str]:
    """Labels that change, to what they become.

    Speakers of ``least`` vectors or more are clustered by average linkage and take the lowest
    label of their cluster; others join the nearest of those within ``threshold``, ties the
    lowest label.
    """
    order = sorted(range(len(names)), key=lambda k: id_order(names[k]))
    names, many, x = [names[k] for k in order], np.asarray(counts)[order] >= least, np.asarray(means, float)[order]
    core, out = np.flatnonzero(many), {}
    groups = average_link(x[core], threshold)
    heads = {int(g): int(core[np.argmax(groups == g)]) for g in groups}
    for k, g in zip(core.tolist(), groups.tolist(), strict=True):
        out[names[k]] = names[heads[g]]
    lead = sorted(heads.values())
    for k in np.flatnonzero(~many).tolist() if lead else []:
        d = 1 - x[lead] @ x[k]
        if d.min() <= threshold:
            out[names[k]] = names[lead[int(np.argmin(d))]]
    return {a: b for a, b in out.items() if a != b}


def merge_map(means: DataFrame, recording: str, speaker: str, threshold: float = 0.45, least: int = 3) -> DataFrame:
    """``(recording, speaker, mapped)`` of the labels that change, as in ``merged_names``.

    A recording's speakers, not its segments, are one task's work.
    """

    def run(pdf):
        import pandas as pd

        got = merged_names(pdf[speaker].tolist(), pdf["n"].to_numpy(), np.array(pdf["mean"].tolist(), float), threshold, least)
        rows = [(pdf[recording].iloc[0], a, b) for a, b in got.items()]
        return pd.DataFrame(rows, columns=[recording, speaker, "mapped"])

    kind = dict(means.dtypes)[recording]
    return means.select(recording, speaker, "n", "mean").groupBy(recording).applyInPandas(run, f"{recording} {kind}, {speaker} string, mapped string")


def relabelled(segments: DataFrame, mapping: DataFrame, recording: str, speaker: str) -> DataFrame:
    """Segments under their mapped labels; a label without a map stays."""
    got = segments.join(mapping.select(recording, speaker, "mapped"), [recording, speaker], "left")
    return got.withColumn(speaker, F.coalesce("mapped", speaker)).select(*segments.columns)


def _spot(start: str, end: str) -> list[Column]:
    """Times to the millisecond, by which segments and vectors meet."""
    return [F.round(F.col(c) * 1000).cast("long").alias(f"_{k}") for k, c in enumerate((start, end))]


def reclustered(segments: DataFrame, store: DataFrame, recording: str, speaker: str, order: str, vector: str = "vector", threshold: float = 0.7) -> DataFrame:
    """Segments relabelled by clusters of their own vectors, SPEAKER_0 first to speak.

    ``segments`` and ``store`` have ``start`` and ``end`` in seconds and meet where both agree to
    the millisecond; of several vectors there the last in ``order`` counts.  Segments without a
    vector keep their label, and so do recordings of fewer than two vectors.
    """

    def run(pdf):
        pdf = pdf.sort_values(order)
        group = average_link(np.array(pdf[vector].tolist(), float), threshold) if len(pdf) > 1 else np.full(len(pdf), -1)
        return pdf.assign(_g=group.astype(np.int64))[[recording, order, "_0", "_1", "_g"]]

    kinds = dict(store.dtypes)
    rows = store.select(recording, order, vector, *_spot("start", "end"))
    by = rows.groupBy(recording).applyInPandas(run, f"{recording} {kinds[recording]}, {order} {kinds[order]}, _0 long, _1 long, _g long").where("_g >= 0")
    last = by.groupBy(recording, "_0", "_1").agg(F.max_by("_g", order).alias("_g"))
    got = segments.select("*", *_spot("start", "end")).join(last, [recording, "_0", "_1"], "left")
    # the first place of each cluster, then clusters in order of it; segments without one apart
    first = got.where("_g is not null").groupBy(recording, "_g").agg(F.min(F.struct("start", order)).alias("_at"))
    named = first.select(recording, "_g", (F.row_number().over(Window.partitionBy(recording).orderBy("_at")) - 1).alias("_id"))
    out = got.join(named, [recording, "_g"], "left")
    return out.withColumn(speaker, F.coalesce(F.concat(F.lit("SPEAKER_"), "_id"), speaker)).select(*segments.columns)
