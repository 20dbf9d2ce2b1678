"""A registry of voices for each recording, kept while its windows arrive in order.

A window's voice takes the known speaker with the highest cosine if that is high enough, and
moves that speaker's centroid; otherwise it opens a new speaker.  The same step serves a stream
(state in Spark's state store) and a whole table (state carried along a sorted partition, so
that a recording of any length needs the memory of one batch and its centroids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The least cosine of a match and the weight of the old centroid.
MATCH = 0.60
KEEP = 0.9

STATE = "last bigint, hits array<bigint>, centroids array<array<double>>"
OUT = "window bigint, speaker string, similarity double, late boolean"


def _unit(x: np.ndarray) -> np.ndarray:
    size = float(np.linalg.norm(x))
    return x / size if np.isfinite(size) and size >= 1e-8 else np.zeros_like(x)


class Voices:
    """Centroids and hits of one recording's speakers, and the last window seen."""

    def __init__(self, last: int = -1, hits=(), centroids=()):
        self.last, self.hits, self.centroids = last, list(hits), [np.asarray(c, np.float64) for c in centroids]

    def state(self) -> tuple:
        return self.last, [int(n) for n in self.hits], [c.tolist() for c in self.centroids]

    def take(self, window: int, vector) -> tuple[str | None, float, bool]:
        """Speaker, cosine and whether the window came late (then nothing changes).

        A vector that is null or has no direction gets no speaker and changes no centroid.
        """
        if window <= self.last:
            return None, 0.0, True
        self.last = window
        v = _unit(np.asarray(vector if vector is not None else [0.0], np.float64))
        if not v.any():
            return None, 0.0, False
        score = [float(c @ v) for c in self.centroids]
        best = int(np.argmax(score)) if score else -1
        if best >= 0 and score[best] >= MATCH:
            self.centroids[best] = _unit(KEEP * self.centroids[best] + (1 - KEEP) * np.asarray(vector, np.float64))
            self.hits[best] += 1
            return f"SPEAKER_{best}", score[best], False
        self.centroids.append(v)
        self.hits.append(1)
        return f"SPEAKER_{len(self.hits) - 1}", score[best] if score else 0.0, False


def _labelled(pdf: pd.DataFrame, key: str, voices: Voices) -> pd.DataFrame:
    got = [voices.take(w, v) for w, v in zip(pdf["window"], pdf["vector"], strict=True)]
    return pd.DataFrame(
        {key: pdf[key].to_numpy(), "window": pdf["window"].to_numpy(), "speaker": [g[0] for g in got], "similarity": [g[1] for g in got], "late": [g[2] for g in got]}
    )


def _named(rows: DataFrame, key: str, window: str, vector: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col(window).isNotNull()).select(
        key, F.col(window).cast("bigint").alias("window"), F.col(vector).cast("array<double>").alias("vector")
    )


def label_windows(rows: DataFrame, key: str, window: str, vector: str) -> DataFrame:
    """``key, window, speaker, similarity, late`` of a whole table; a repeated window is late.

    Rows without a key or a window are left out.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, voices = None, Voices()
        for pdf in batches:
            for k, part in pdf.groupby(key, sort=False):
                if k != now:
                    now, voices = k, Voices()
                yield _labelled(part, key, voices)

    ordered = _named(rows, key, window, vector).repartition(key).sortWithinPartitions(key, "window", "vector")
    return ordered.mapInPandas(run, f"{key} {kind}, {OUT}")


def label_stream(rows: DataFrame, key: str, window: str, vector: str) -> DataFrame:
    """The same over a stream, in append mode: windows of a batch are put in order, one that
    comes after a later one was seen in an earlier batch is marked late and gets no speaker."""
    kind = dict(rows.dtypes)[key]

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        voices = Voices(*state.get) if state.exists else Voices()
        pdf = pd.concat(list(parts), ignore_index=True).sort_values("window", kind="stable")
        yield _labelled(pdf, key, voices)
        state.update(voices.state())

    return _named(rows, key, window, vector).groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, {OUT}", STATE, "append", GroupStateTimeout.NoTimeout
    )
