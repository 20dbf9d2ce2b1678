"""Speakers of a recording from its windows' speakers, kept apart where one window heard both.

Units are a window's speakers.  The likest two clusters merge first; clusters that hold units
of one window count as less alike by a penalty, since the window told them apart, and only
overwhelming likeness joins them.  Clusters of few seconds then join the likest large one, and
units without a vector keep the name their window gave them.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.shaping import budget_parts
from colloquy.operators.vectors import centroids

# The least likeness of a merge, what a shared window takes off, the seconds below
# which a cluster is too small to stand alone, and the seconds of a unit that make its vector.
THRESHOLD, PENALTY, SMALL_S, POOL_S = 0.55, 0.35, 8.0, 30.0


class _Clusters:
    """Directions and windows of the clusters that are left, by the number of their first unit."""

    def __init__(self, vectors: np.ndarray, windows: list, penalty: float):
        self.at = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        kinds = {w: k for k, w in enumerate(dict.fromkeys(windows))}
        self.windows = np.zeros((len(windows), len(kinds)), bool)
        self.windows[np.arange(len(windows)), [kinds[w] for w in windows]] = True
        self.n, self.alive, self.penalty = np.ones(len(windows)), np.ones(len(windows), bool), penalty

    def apart(self, i: int) -> np.ndarray:
        """Which clusters share a window with one."""
        return self.windows[:, self.windows[i]].any(axis=1)

    def likeness(self, i: int) -> np.ndarray:
        return self.at @ self.at[i] - self.penalty * self.apart(i)

    def merge(self, i: int, j: int) -> None:
        whole = self.at[i] * self.n[i] + self.at[j] * self.n[j]
        self.at[i] = whole / np.linalg.norm(whole)
        self.n[i] += self.n[j]
        self.windows[i] |= self.windows[j]
        self.alive[j] = False


def constrained_clusters(
    vectors: np.ndarray, windows: list, seconds: np.ndarray, threshold: float = THRESHOLD, penalty: float = PENALTY, small_s: float = SMALL_S
) -> np.ndarray:
    """Cluster numbers of the units, by each cluster's first unit before small ones join it.

    Of equally like pairs the one of the lowest numbers merges.  A heap holds the best later
    partner of each cluster and is asked anew where that partner has changed, so memory is that
    of the units.
    """
    c, label = _Clusters(vectors, windows, penalty), np.arange(len(windows))
    heap: list[tuple[float, int, int, int]] = []
    #: Best later partner of each cluster, and how often the entry of it has been replaced.
    partner, value, turn = [-1] * len(label), [-np.inf] * len(label), [0] * len(label)

    def put(i: int, j: int, like: float) -> None:
        turn[i] += 1
        partner[i], value[i] = j, like
        heapq.heappush(heap, (-like, i, j, turn[i]))

    def ask(i: int) -> None:
        like = np.where(c.alive, c.likeness(i), -np.inf)[i + 1 :]
        partner[i], value[i] = -1, -np.inf
        turn[i] += 1
        if len(like) and like.max() > threshold:
            put(i, i + 1 + int(like.argmax()), float(like.max()))

    for i in range(len(label)):
        ask(i)
    while heap:
        _, i, j, t = heapq.heappop(heap)
        if t != turn[i] or not c.alive[i]:
            continue
        c.merge(i, j)
        label[label == j] = i
        turn[j] += 1
        like = c.likeness(i)
        for k in np.flatnonzero(c.alive[:j]).tolist():
            if k == i or partner[k] in (i, j):
                ask(k)
            elif k < i and like[k] > threshold and (-like[k], i) < (-value[k], partner[k] if partner[k] >= 0 else i + 1):
                put(k, i, float(like[k]))
    return np.unique(_absorbed(c, label, np.asarray(seconds, float), small_s), return_inverse=True)[1]


def _absorbed(c: _Clusters, label: np.ndarray, seconds: np.ndarray, small_s: float) -> np.ndarray:
    """Small clusters, shortest first, go to the likest large one that shares no window with them."""
    total = np.bincount(label, seconds, len(label))
    large = np.flatnonzero(c.alive & (total >= small_s))
    for i in sorted(np.flatnonzero(c.alive & (total < small_s)).tolist(), key=lambda k: total[k]):
        free = large[~c.apart(i)[large]]
        if len(free):
            like = c.at[free] @ c.at[i]
            j = int(free[len(free) - 1 - int(like[::-1].argmax())])  # of equals the last
            c.windows[j] |= c.windows[i]
            label[label == i] = j
    return label


def pooled_units(segments: DataFrame, recording: str, window: str, tag: str, order: str, seconds: str, vector: str, pool_s: float = POOL_S) -> DataFrame:
    """``(recording, window, tag, first, seconds, vector)``: a window's speakers and their voices.

    The vector is the direction of the first ``pool_s`` seconds, weighted by seconds; null where
    no segment has one.  ``first`` is the place of the first segment.
    """
    keys = [recording, window, tag]
    used = budget_parts(segments, keys, [order], seconds, pool_s)
    every = used.groupBy(*keys).agg(F.min(order).alias("first"), F.sum(seconds).cast("double").alias("seconds"))
    heard = used.where(F.col(vector).isNotNull() & (F.col("used") > 0)).withColumn("_u", F.struct(*keys))
    voices = centroids(heard, "_u", vector, F.col("used").cast("double")).select("_u.*", F.col("centroid").alias("vector"))
    return every.join(voices, keys, "left")


def constrained_speakers(
    units: DataFrame, recording: str, window: str, tag: str, threshold: float = THRESHOLD, penalty: float = PENALTY, small_s: float = SMALL_S
) -> DataFrame:
    """``(recording, window, tag, speaker)`` of every unit of ``pooled_units``; S01 is the first heard.

    Units of a recording are one task's work, in memory of their vectors and windows.  A unit
    without a vector keeps its tag.
    """
    kinds = dict(units.dtypes)

    def run(pdf):
        pdf = pdf.sort_values(["first", tag], ignore_index=True)
        x = np.array(pdf["vector"].tolist(), float)
        group = constrained_clusters(x, pdf[window].tolist(), pdf["seconds"].to_numpy(float), threshold, penalty, small_s)
        return pdf.assign(speaker=[f"S{g + 1:02d}" for g in group])[[recording, window, tag, "speaker"]]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (recording, window, tag)) + ", speaker string"
    named = units.where("vector is not null").groupBy(recording).applyInPandas(run, schema)
    rest = units.where("vector is null").select(recording, window, tag, F.col(tag).cast("string").alias("speaker"))
    return named.unionByName(rest)


def with_speakers(segments: DataFrame, speakers: DataFrame, recording: str, window: str, tag: str) -> DataFrame:
    """Segments with the ``speaker`` of their unit."""
    return segments.join(speakers, [recording, window, tag], "left")


def speaker_counts(speakers: DataFrame, recording: str) -> DataFrame:
    """``(recording, units, speakers, busiest)``: how units fall to speakers; busiest has most units."""
    by = speakers.groupBy(recording, "speaker").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(recording).orderBy(F.desc("n"), "speaker"))
    return by.withColumn("_p", place).groupBy(recording).agg(F.sum("n").alias("units"), F.count("*").alias("speakers"), F.max(F.when(F.col("_p") == 1, F.col("speaker"))).alias("busiest"))
