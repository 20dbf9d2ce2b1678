"""How many speakers a recording has, from the spectrum of its voices' affinity.

With unit vectors U the affinity is U U' and its degrees D follow from the vectors' sum, so the
normalised Laplacian's eigenvalues are one minus those of U' D^-1 U, a matrix of the vectors'
size whatever the recording's length.  Tasks add up parts of it; no matrix of all pairs exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.linkage import cut_into, dendrogram
from colloquy.operators.shaping import merged_regions, smoothed
from colloquy.operators.vectors import dot, unit

# The greatest number looked for by the two users of the estimate.
MOST_SPEAKERS, MOST_UNITS = 10, 9
#: Recordings whose parts a task holds at once.
HELD = 64


def laplacian_values(rows: DataFrame, recording: str, vector: str, most: int = MOST_SPEAKERS) -> DataFrame:
    """``(recording, n, values)``: the ``most`` + 1 smallest eigenvalues of the normalised Laplacian.

    Vectors without direction (null ones too) are left out of n and of the affinity.  The
    finishing task of a recording adds up one matrix for each part of the input that holds some
    of it.
    """
    import pandas as pd

    kind = dict(rows.dtypes)[recording]
    known = rows.where(F.col(vector).isNotNull()).select(recording, unit(F.col(vector)).alias("u")).where(F.exists("u", lambda x: x != 0))
    long = known.select(recording, F.posexplode("u").alias("k", "x")).groupBy(recording, "k").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    total = long.groupBy(recording).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("s"))
    scaled = known.join(total, recording).select(recording, "n", "u", F.greatest(dot(F.col("u"), F.col("s")), F.lit(1e-9)).alias("d"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def out():
            got = pd.DataFrame({recording: [k for k, _ in held], "n": [n for _, n in held], "part": [m.ravel() for m in held.values()]})
            held.clear()
            return got

        for b in batches:
            for key, pdf in b.groupby([recording, "n"], sort=False):
                u = np.array(pdf["u"].tolist(), float)
                m = u.T @ (u / pdf["d"].to_numpy()[:, None])
                held[key] = held[key] + m if key in held else m
                if len(held) >= HELD:
                    yield out()
        yield out()

    def finish(pdf):
        m = np.sum(pdf["part"].tolist(), axis=0)
        n, size = int(pdf["n"].iloc[0]), int(round(len(m) ** 0.5))
        own = np.linalg.eigvalsh(m.reshape(size, size))[::-1]
        own = np.concatenate([own, np.zeros(max(0, n - size))])[: min(n, most + 1)]
        return pd.DataFrame({recording: [pdf[recording].iloc[0]], "n": [n], "values": [(1 - own).tolist()]})

    parts = scaled.mapInPandas(partial, f"{recording} {kind}, n long, part array<double>")
    return parts.groupBy(recording).applyInPandas(finish, f"{recording} {kind}, n long, values array<double>")


def estimated_count(rows: DataFrame, recording: str, vector: str, most: int = MOST_SPEAKERS) -> DataFrame:
    """``(recording, n, k)``: k from 2 to ``most`` where the gap after the k-th eigenvalue is widest.

    The gap after the first is not looked at.  One vector or two are as many speakers; three
    are where gaps begin.  Of equal gaps the first counts.
    """
    v = laplacian_values(rows, recording, vector, most)
    gaps = F.transform(F.sequence(F.lit(1), F.size("values") - 2), lambda i: F.struct((F.get("values", i) - F.get("values", i + 1)).alias("g"), (i + 1).alias("k")))
    return v.select(recording, "n", F.when(F.size("values") < 3, F.col("n").cast("int")).otherwise(F.array_min(gaps)["k"]).alias("k"))


def diarized(spans: DataFrame, recording: str, order: str, vector: str, hop: int, reach: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """``(recording, region, start, end, speaker, n)``: who speaks when, from windows' voices.

    ``spans`` are a recording's windows of speech (``start`` and ``end`` in ms) with a vector
    each.  The number of speakers is estimated unless ``counts(recording, k)`` tells it; windows
    are clustered by average linkage into that many, labels smoothed by the commonest one
    within ``reach`` windows, named SPEAKER_0, SPEAKER_1, .. as they first speak, and neighbours
    of one speaker that begin no more than ``hop`` after the other's end are one region.  Windows
    without a voice are left out.
    """
    k = counts if counts is not None else estimated_count(spans, recording, vector)
    got = cut_into(dendrogram(spans, recording, order, vector), recording, order, k)
    even = smoothed(got, [recording], order, "cluster", reach) if reach else got
    first = even.groupBy(recording, "cluster").agg(F.min(order).alias("_first"))
    name = F.concat(F.lit("SPEAKER_"), (F.row_number().over(Window.partitionBy(recording).orderBy("_first")) - 1).cast("string"))
    labelled = even.join(first.select(recording, "cluster", name.alias("speaker")), [recording, "cluster"]).select(recording, order, "speaker")
    timed = spans.select(recording, order, "start", "end").join(labelled, [recording, order])
    return merged_regions(timed, [recording], "start", "end", "speaker", hop)
