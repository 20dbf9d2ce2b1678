"""Meetings as their windows arrive: who goes on speaking, who is known by voice, and who was one after all.

A window's labels mean nothing outside of it.  A label goes on as the speaker whose words and
time it shares in the overlap with the window before; else it is the known speaker whose voice
is nearest, if near enough; else it is somebody new.  When no window has come for a while the
meeting is over: speakers whose voices turn out to be one are told, and the state goes.

The same fold serves a stream (state in Spark's state store, ended by timers) and a whole table.
Labelling and embedding of sound are plugged in by two small protocols.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.operators.consolidation import merged_names
from colloquy.operators.stitching import Meeting, Turn
from colloquy.streaming.speakers import KEEP, MATCH, _unit

# Ms of a label's speech that make its voice, letters of a snippet.
POOL_MS, SNIPPET = 30_000, 60
#: How long a finished recording's name is remembered, so that what comes then is told to be late.
REMEMBERED_MS = 24 * 3600 * 1000

SEGMENT = "struct<start:bigint,end:bigint,speaker:string,text:string,vector:array<double>>"
OUT = "kind string, offset bigint, start bigint, end bigint, label string, speaker string, similarity double, text string"
KINDS = ("turn", "repeat", "late", "merge")


@runtime_checkable
class Labeler(Protocol):
    """Turns a window of sound into segments ``(start_ms, end_ms, label, text)``, times from its start."""

    def label(self, samples: np.ndarray, rate: int) -> list[tuple[int, int, str, str]]: ...


@runtime_checkable
class Embedder(Protocol):
    """Turns a clip into a vector of ``dim`` numbers; zeros where there is no voice."""

    dim: int

    def embed(self, samples: np.ndarray, rate: int) -> np.ndarray: ...


class CepstralEmbedder:
    """The voice statistics of ``operators.sound`` as an embedder."""

    def __init__(self):
        from colloquy.operators import sound

        self.dim = 4 * sound.VOICE_KEPT

    def embed(self, samples: np.ndarray, rate: int) -> np.ndarray:
        from colloquy.operators.sound import voice_vector

        return voice_vector(samples, rate)


def heard(windows: DataFrame, key: str, rate: int, labeler: Labeler, embedder: Embedder) -> DataFrame:
    """``(key, offset, segments)`` of windows ``(key, offset, samples)``, offsets and times in ms.

    Labeler and embedder travel to the tasks, which hold one window at a time.  Segments that
    end before they start, or beyond the window, are clipped to it; works on tables and streams.
    """
    if not isinstance(labeler, Labeler) or not isinstance(embedder, Embedder):
        raise TypeError("a labeler has label(samples, rate), an embedder dim and embed(samples, rate)")
    kind = dict(windows.dtypes)[key]

    def one(offset: int, samples) -> list[dict]:
        x, out = np.asarray(samples, np.float64), []
        ms = len(x) * 1000 // rate
        for start, end, who, text in labeler.label(x, rate):
            a, b = max(0, min(start, ms)), max(0, min(end, ms))
            v = np.asarray(embedder.embed(x[a * rate // 1000 : b * rate // 1000], rate), np.float64)
            if v.shape != (embedder.dim,):
                raise ValueError(f"the embedder gave {v.shape}, not ({embedder.dim},)")
            out.append({"start": offset + a, "end": offset + max(a, b), "speaker": who, "text": text, "vector": v.tolist()})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "offset": b["offset"], "segments": [one(int(o), s) for o, s in zip(b["offset"], b["samples"], strict=True)]})

    return windows.select(key, F.col("offset").cast("bigint").alias("offset"), "samples").mapInPandas(run, f"{key} {kind}, offset bigint, segments array<{SEGMENT}>")


class Recording:
    """What is known of a recording: its last window's turns, and its speakers' voices."""

    def __init__(self, overlap: int, last: int = -1, voices=(), turns=()):
        self.overlap, self.last = overlap, last
        self.voices = [{"centroid": np.array(v["centroid"], float), "total": np.array(v["total"], float), "n": v["n"]} for v in voices]
        self.turns = [Turn(*t) for t in turns]

    def state(self) -> tuple[int, str, str]:
        voices = [{"centroid": v["centroid"].tolist(), "total": v["total"].tolist(), "n": v["n"]} for v in self.voices]
        return self.last, json.dumps(voices), json.dumps([(t.start, t.end, t.speaker, t.text) for t in self.turns])

    @classmethod
    def of(cls, overlap: int, state: tuple | None) -> Recording:
        return cls(overlap, state[0], json.loads(state[1]), json.loads(state[2])) if state else cls(overlap)

    def _anchor(self, known: str | None, vector: np.ndarray) -> tuple[str, float]:
        """The speaker of a label that goes on from ``known`` or is to be found by voice."""
        size = len(vector)
        score = [float(v["centroid"] @ _unit(vector)) if len(v["centroid"]) == size else 0.0 for v in self.voices]
        best = int(np.argmax(score)) if score else -1
        at = int(known.rpartition("_")[2]) if known else best if best >= 0 and score[best] >= MATCH else -1
        if at < 0:
            self.voices.append({"centroid": _unit(vector), "total": np.array(vector, float), "n": 1})
            return f"SPEAKER_{len(self.voices) - 1}", score[best] if score else 0.0
        v = self.voices[at]
        if size and len(v["centroid"]) in (0, size):
            old = v["centroid"] if len(v["centroid"]) else np.zeros(size)
            v["centroid"] = _unit(KEEP * old + (1 - KEEP) * vector)
            v["total"] = (v["total"] if len(v["total"]) else np.zeros(size)) + vector
        v["n"] += 1
        return f"SPEAKER_{at}", score[at]

    def take(self, offset: int, segments: list[dict]) -> list[tuple]:
        """Rows of a window; one that comes after a later one changes nothing and is marked late."""
        rows = sorted(segments, key=lambda s: (s["start"], s["end"]))
        if offset <= self.last:
            return [("late", offset, s["start"], s["end"], s["speaker"], None, None, s["text"]) for s in rows] or [("late", offset, None, None, None, None, None, None)]
        self.last = offset
        new = [Turn(s["start"], s["end"], s["speaker"] or "", s["text"] or "") for s in rows]
        met = Meeting(self.turns, new, offset, offset + self.overlap)
        goes_on = met.continued([t.speaker for t in self.turns], [t.speaker for t in new])
        names = {}
        for label in dict.fromkeys(t.speaker for t in new):
            names[label] = self._anchor(goes_on.get(label), self._voice([s for s, t in zip(rows, new, strict=True) if t.speaker == label]))
        labels = [t.speaker for t in new]
        for t in new:
            t.speaker = names[t.speaker][0]
        again = met.versions([t.speaker for t in self.turns], [t.speaker for t in new]).any(axis=0)
        self.turns = new
        return [
            ("repeat" if again[k] else "turn", offset, t.start, t.end, labels[k], t.speaker, names[labels[k]][1], t.text) for k, t in enumerate(new)
        ]

    @staticmethod
    def _voice(segments: list[dict]) -> np.ndarray:
        """The first ``POOL_MS`` of a label's segments as one vector, weighted by time."""
        left, total = POOL_MS, np.zeros(0)
        for s in segments:
            use = min(max(s["end"] - s["start"], 0), left)
            if s["vector"] is not None and len(s["vector"]) and use > 0:
                v = _unit(np.asarray(s["vector"], np.float64)) * use
                total = v if not len(total) else total + v
            left -= use
        return _unit(total) if len(total) else total

    def end(self) -> list[tuple]:
        """Speakers who are one after all, as rows of their old and new names."""
        whole = [(f"SPEAKER_{k}", v["n"], _unit(v["total"])) for k, v in enumerate(self.voices) if len(v["total"]) and v["total"].any()]
        if not whole:
            return []
        names, n, means = zip(*whole, strict=True)
        got = merged_names(list(names), np.array(n), np.array(means))
        return [("merge", self.last, None, None, a, b, None, None) for a, b in sorted(got.items())]


def _frame(key: str, value, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])
    out.insert(0, key, pd.Series([value] * len(out), dtype=object))
    return out.astype({"offset": "Int64", "start": "Int64", "end": "Int64", "similarity": "float64"})


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col("offset").isNotNull()).select(
        key, F.col("offset").cast("bigint").alias("offset"), F.coalesce("segments", F.array()).cast(f"array<{SEGMENT}>").alias("segments")
    )


def _segments(cell) -> list[dict]:
    return [s.asDict() if hasattr(s, "asDict") else dict(s) for s in cell]


def label_meetings(rows: DataFrame, key: str, overlap: int) -> DataFrame:
    """``key`` and ``OUT`` of a whole table ``(key, offset, segments)``, ended at each recording's last window.

    Rows of kind ``turn`` are new, those of kind ``repeat`` are versions of a turn of the window
    before, ``late`` ones repeat a window, ``merge`` rows tell which speaker is which other one.
    Rows without a key or an offset are left out.  A recording is folded along its sorted
    partition; what is held is one window and the speakers' voices.
    """
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, meeting = None, None
        for pdf in batches:
            for k, offset, segments in pdf.itertuples(index=False):
                if meeting is None or k != now:
                    if meeting is not None:
                        yield _frame(key, now, meeting.end())
                    now, meeting = k, Recording(overlap)
                yield _frame(key, k, meeting.take(int(offset), _segments(segments)))
        if meeting is not None:
            yield _frame(key, now, meeting.end())

    ordered = _named(rows, key).repartition(key).sortWithinPartitions(key, "offset")
    return ordered.mapInPandas(run, f"{key} {kind}, {OUT}")


class _Meetings(StatefulProcessor):
    def __init__(self, key: str, overlap: int, idle_ms: int, remembered_ms: int):
        self.key, self.overlap, self.idle_ms, self.remembered_ms = key, overlap, idle_ms, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meeting = handle.getValueState("meeting", "last bigint, voices string, turns string")
        self.ended = handle.getValueState("ended", "last bigint", ttlDurationMs=self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        windows = pd.concat(list(rows), ignore_index=True).sort_values("offset", kind="stable")
        over = self.ended.exists() and not self.meeting.exists()
        meeting = Recording.of(self.overlap, self.meeting.get() if self.meeting.exists() else None)
        if over:  # the recording was ended: all of it is late
            meeting.last = max(int(windows["offset"].max()), int(self.ended.get()[0]))
        for offset, segments in zip(windows["offset"], windows["segments"], strict=True):
            yield _frame(self.key, key[0], meeting.take(int(offset), _segments(segments)))
        if not over:
            self.meeting.update(meeting.state())
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.meeting.exists():
            meeting = Recording.of(self.overlap, self.meeting.get())
            self.ended.update((meeting.last,))
            self.meeting.clear()
            yield _frame(self.key, key[0], meeting.end())

    def close(self) -> None:
        pass


def meeting_stream(rows: DataFrame, key: str, overlap: int, idle_ms: int, remembered_ms: int = REMEMBERED_MS) -> DataFrame:
    """The same over a stream, in append mode: a recording ends when no window has come for ``idle_ms``.

    Its ``merge`` rows come then and its state goes; only its name and last window stay for
    ``remembered_ms``, in which whatever still comes is marked late.  The query goes on looking for
    ended recordings without new input, so it runs until it is stopped, whatever its trigger.  Windows of one batch are put
    in order; one that comes after a later one of an earlier batch is late.  Needs the RocksDB
    state store.
    """
    kind = dict(rows.dtypes)[key]
    return _named(rows, key).groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Meetings(key, overlap, idle_ms, remembered_ms), outputStructType=f"{key} {kind}, {OUT}", outputMode="append", timeMode="processingTime"
    )


def to_sinks(stream: DataFrame, folder: str, checkpoint: str):
    """A stream writer that puts each kind of rows into a table of its own, ``folder/<kind>``.

    A batch that is run again after a failure writes over what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for kind in [r.kind for r in held.select("kind").distinct().collect()]:  # one of KINDS
            held.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        held.unpersist()

    return stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)


def relabelled_turns(labelled: DataFrame, key: str) -> DataFrame:
    """New turns of ``label_meetings`` or of the stream's tables under the speakers' last names."""
    merges = labelled.where("kind = 'merge'").select(key, F.col("label").alias("speaker"), F.col("speaker").alias("_to"))
    turns = labelled.where("kind = 'turn'").join(merges, [key, "speaker"], "left")
    return turns.select(key, "start", "end", F.coalesce("_to", "speaker").alias("speaker"), "text")
