"""Windows that end in pauses: each begins where the one before was cut.

The cut of a window depends on where the window begins, so a recording looks like one task's
walk.  Here every frame is asked first where a window that begins there would be cut, in blocks
of frames side by side; the frames at which windows really begin are then found by doubling:
the first ``2^k`` of them and the jump over ``2^k`` cuts give the first ``2^(k+1)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.shared import Stages

#: Frames of a recording that one task looks at together, besides those of one window more.
BLOCK = 36_000


def next_cuts(frames: DataFrame, key: str, place: str, energy: str, window: int, snap: int, pool: int, least: int, block: int = BLOCK) -> DataFrame:
    """``(key, start, cut, last)``: where a window that begins at each frame would be cut.

    Frames of a key are numbered from 0 without gaps.  A window is ``window`` frames long and
    is cut in the middle of the quietest ``pool`` neighbouring frames among its last ``snap``,
    the first of equally quiet ones; one that reaches the end of the recording is not cut and
    is the last.  Frames with fewer than ``least`` frames from them on begin no window.
    """
    if not pool <= snap < window:
        raise ValueError("a pause lies within the snap, and the snap within the window")
    rows = frames.select(key, F.col(place).cast("long").alias("start"), F.col(energy).alias("_e"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.floor((F.col("start") - window) / block), F.floor(F.col("start") / block)))).where("_b >= 0")
    kinds = dict(frames.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("start")
        start, n = t["start"].to_numpy(), t.num_rows
        e = pc.fill_null(t["_e"], 0).to_numpy()
        known = t["_e"].is_valid().to_numpy().astype(np.int64)
        shifted = lambda x: sum(np.append(x[k:], np.zeros(min(k, n), x.dtype)) for k in range(pool))
        # frames without any energy are the quietest
        quiet = np.where(shifted(known) > 0, shifted(e), -np.inf if e.dtype.kind == "f" else np.iinfo(np.int64).min)
        own = np.flatnonzero((start // block == t["_b"][0].as_py())[: max(n - least + 1, 0)])
        whole = own[own + window < n]
        cut = np.full(len(own), start[-1] + 1)
        if len(whole):
            near = np.lib.stride_tricks.sliding_window_view(quiet, snap - pool + 1)
            # the first of equally quiet ones
            cut[: len(whole)] = start[whole + window - snap + near[whole[0] + window - snap : whole[-1] + window - snap + 1].argmin(axis=1)] + pool // 2
        return pa.table({key: t[key].slice(0, len(own)), "start": start[own], "cut": cut, "last": own + window >= n})

    return rows.groupBy(key, "_b").applyInArrow(run, f"{key} {kinds[key]}, start long, cut long, last boolean")


def followed(jumps: DataFrame, key: str, start: str, to: str) -> DataFrame:
    """``(key, start)`` of what the jumps lead to from 0, ``to`` lying ahead of ``start``.

    A jump to where none begins, or to null, ends the walk.  The number of rounds is the binary
    logarithm of the steps of the longest walk.
    """
    stages = Stages()
    hop = stages.keep(jumps.select(key, F.col(start).alias("_a"), F.col(to).alias("_z")).where("_z is not null"), "cursor-hops")
    seen = stages.keep(jumps.where(F.col(start) == 0).select(key, F.col(start).alias("_a")), "cursor-seen")
    there = jumps.select(key, F.col(start).alias("_z"))
    while True:
        new = stages.keep(seen.join(hop, [key, "_a"]).select(key, "_z").join(there, [key, "_z"]).select(key, F.col("_z").alias("_a")), "cursor-new")
        if not new.head(1):
            return seen.select(key, F.col("_a").alias(start))
        both = stages.keep(seen.unionByName(new), "cursor-seen")
        ahead = hop.select(key, F.col("_a").alias("_z"), F.col("_z").alias("_y"))
        far = stages.keep(hop.join(ahead, [key, "_z"]).select(key, "_a", F.col("_y").alias("_z")), "cursor-hops")
        stages.drop(seen, hop, new)
        seen, hop = both, far


def pause_windows(frames: DataFrame, key: str, place: str, energy: str, window: int, snap: int, pool: int = 4, least: int = 10, block: int = BLOCK) -> DataFrame:
    """``(key, window, start, cut, last)``: the windows of each recording, in frames.

    As a walk from frame 0 that goes on at each cut; what is left of fewer than ``least``
    frames gets no window.  A recording of any length is many tasks' work: cuts are found by
    block and followed by joins on key and frame.
    """
    stages = Stages()
    cuts = stages.keep(next_cuts(frames, key, place, energy, window, snap, pool, least, block), "cursor-cuts")
    # a window begins at 0 or where another may be cut, which few frames are
    begins = cuts.where(~F.col("last")).select(key, F.col("cut").alias("start")).distinct().unionByName(cuts.where("start = 0").select(key, "start"))
    jumps = stages.keep(cuts.join(begins.distinct(), [key, "start"], "left_semi"), "cursor-jumps")
    stages.drop(cuts)
    begun = followed(jumps.withColumn("to", F.when(~F.col("last"), F.col("cut"))), key, "start", "to")
    order = Window.partitionBy(key).orderBy("start")
    return jumps.join(begun, [key, "start"]).select(key, (F.row_number().over(order) - 1).alias("window"), "start", "cut", "last")


def cut_segments(segments: DataFrame, windows: DataFrame, key: str, margin: int) -> DataFrame:
    """Segments ``(key, window, start, ..)`` that begin ``margin`` or more before their window's cut."""
    cut = windows.select(key, "window", F.col("cut").alias("_cut"))
    return segments.join(cut, [key, "window"]).where(F.col("start") < F.col("_cut") - margin).drop("_cut")
