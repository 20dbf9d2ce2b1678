"""Sound in pieces: spectra, mel bands, resampling, voice statistics and speech, over blocks of samples.

A recording is any number of rows ``(recording, start, samples)``, in samples from 0.  Work on it
is cut into blocks of samples; a piece is sent to each block that it reaches into, with what a
block needs of its neighbours, so no task holds more than a block and a recording of any length
is many tasks' work.  Results do not depend on how the samples were cut into pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.vectors import unit

# Fixed values of the fingerprint: bands, their lowest frequency, seconds of a spectrum, spectra of
# a block, levels; of the voice statistics: bands, coefficients, lowest frequency, seconds of a
# spectrum and of a step, least seconds; of speech: ms of a frame, decibels below the loud frames.
PRINT_BANDS, PRINT_LOW_HZ, PRINT_S, PRINT_POOL, LEVELS = 16, 50.0, 0.05, 10, 8
VOICE_BANDS, VOICE_KEPT, VOICE_LOW_HZ, VOICE_S, VOICE_STEP_S, VOICE_LEAST_S = 40, 24, 20.0, 0.025, 0.010, 0.2
SPEECH_FRAME_MS, SPEECH_DB, LOUD = 30, -35.0, 0.95
TINY = 1e-10
#: Spectra of one block, a multiple of ``PRINT_POOL``.
AT_ONCE = 600


def downmixed(sound: DataFrame, recording: str, samples: str = "samples") -> DataFrame:
    """Channels, rows of one ``start`` and equally many samples each, as one: their mean."""
    channels = F.array_sort(F.collect_list(samples))  # as many as a recording has channels
    n = sound.groupBy(recording, "start").agg(channels.alias("_c"))
    total = F.reduce(F.slice("_c", 2, F.size("_c")), F.transform(F.get("_c", F.lit(0)), lambda x: x.cast("double")), lambda a, b: F.zip_with(a, b, lambda x, y: x + y.cast("double")))
    return n.select(recording, "start", F.transform(total, lambda x: x / F.size("_c")).alias(samples))


def lengths(sound: DataFrame, recording: str) -> DataFrame:
    """``(recording, length)`` in samples."""
    return sound.groupBy(recording).agg(F.max(F.col("start") + F.size("samples")).alias("length"))


def by_block(sound: DataFrame, recording: str, size: int, before: int, after: int, work: Callable, fields: str) -> DataFrame:
    """``work(samples, first, block, length)`` of each block, as rows ``(recording, fields)``.

    Block k is handed the samples from ``k * size - before`` to ``(k + 1) * size + after``, zeros
    where there are none, and the recording's length; ``first`` is the place of the first one
    handed over.  ``work`` gives a dict of columns.  Blocks begin inside the recording; one in
    which no piece has a sample is not asked.
    """
    import pandas as pd

    s, n = F.col("start"), F.size("samples")
    reach = F.sequence(F.greatest(F.floor((s - after) / size), F.lit(0)), F.greatest(F.floor((s + n - 1 + before) / size), F.lit(0)))
    rows = sound.where(n > 0).select(recording, "start", "samples", F.explode(reach).alias("_b"))
    lo = F.greatest(F.col("_b") * size - before - s, F.lit(0))
    hi = F.least((F.col("_b") + 1) * size + after - s, n)
    cut = rows.select(recording, "_b", (s + lo).alias("_s"), F.slice("samples", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).cast("array<double>").alias("_x"))
    sized = cut.join(lengths(sound, recording).withColumnRenamed("length", "_n"), recording).where(F.col("_b") * size < F.col("_n"))

    def run(pdf):
        block, length = int(pdf["_b"].iloc[0]), int(pdf["_n"].iloc[0])
        first = block * size - before
        x = np.zeros(size + before + after)
        for at, part in zip(pdf["_s"] - first, pdf["_x"], strict=True):
            x[at : at + len(part)] = part
        got = work(x, first, block, length)
        rows = len(next(iter(got.values())))
        got = {k: v if rows else pd.Series([], dtype=object) for k, v in got.items()}
        return pd.DataFrame({recording: pd.Series([pdf[recording].iloc[0]] * rows, dtype=object), **got})

    kind = dict(sound.dtypes)[recording]
    return sized.groupBy(recording, "_b").applyInPandas(run, f"{recording} {kind}, {fields}")


def resampled(sound: DataFrame, recording: str, rate: int, to: int) -> DataFrame:
    """The sound at another rate, through a Kaiser-windowed low pass; of ``ceil(n * to / rate)`` samples."""
    ratio = Fraction(to, rate).limit_denominator(10_000)
    up, down = ratio.numerator, ratio.denominator
    if up == down:
        return sound.select(recording, "start", F.col("samples").cast("array<double>").alias("samples"))
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    low_pass = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    low_pass *= up / low_pass.sum()
    reach = half // up + 1
    block = max(1, 48_000 // down) * down  # a block of the input is a whole number of the output's samples

    def work(x, first, number, length):
        m = np.arange(number * block // down * up, min((number + 1) * block // down * up, -(-length * up // down)))
        near = m * down // up
        j = near[:, None] + np.arange(-reach, reach + 1)
        tap = m[:, None] * down - j * up + half
        weight = np.where((tap >= 0) & (tap <= 2 * half), low_pass[np.clip(tap, 0, 2 * half)], 0)
        y = (x[j - first] * weight).sum(axis=1)
        return {"start": [int(m[0])] if len(m) else [], "samples": [y] if len(m) else []}

    return by_block(sound, recording, block, reach, reach, work, "start long, samples array<double>")


def mel_filters(bands: int, low_hz: float, freqs: np.ndarray) -> np.ndarray:
    """Triangles between ``bands`` + 2 points evenly apart on the mel scale, to the last frequency."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    hz = 700.0 * (10.0 ** (np.linspace(mel(low_hz), mel(freqs[-1]), bands + 2) / 2595.0) - 1.0)
    up = (freqs - hz[:-2, None]) / np.maximum(hz[1:-1, None] - hz[:-2, None], 1e-9)
    down = (hz[2:, None] - freqs) / np.maximum(hz[2:, None] - hz[1:-1, None], 1e-9)
    return np.clip(np.minimum(up, down), 0.0, None)


def _power(frames: np.ndarray) -> np.ndarray:
    """Power spectra of Hann-windowed rows, scaled by the window's sum."""
    n = frames.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return np.abs(np.fft.rfft(frames * hann, axis=1) / hann.sum()) ** 2


def fingerprints(sound: DataFrame, recording: str, rate: int) -> DataFrame:
    """``(recording, print)``: a spectral hash that copies of any level and downmixes share.

    Spectra of 50 ms side by side, the first centred on the first sample; ten of them pooled in
    16 mel bands; log powers between the recording's least and greatest in eight levels.  What is
    left of fewer than ten spectra counts only where there is nothing else.  32 bytes a second of
    sound are gathered for the hash.
    """
    n = max(round(rate * PRINT_S), 16)
    fb = mel_filters(PRINT_BANDS, PRINT_LOW_HZ, np.linspace(0.0, rate / 2.0, n // 2 + 1))
    pool = PRINT_POOL

    def work(x, first, block, length):
        spectra = -(-(max(length, n) + 2 * (n // 2)) // n)  # of the whole recording, with half a one at each end
        mine = max(min(spectra - block * AT_ONCE, AT_ONCE), 0)
        bands = _power(x[: mine * n].reshape(mine, n)) @ fb.T
        whole = max(spectra // pool, 1)
        at = [k for k in range(-(-mine // pool)) if block * AT_ONCE // pool + k < whole]
        pooled = [bands[k * pool : (k + 1) * pool].mean(axis=0) for k in at]
        return {"pool": [block * AT_ONCE // pool + k for k in at], "bands": pooled, "peak": [float(np.abs(x).max())] * len(at)}

    # a pool lies in one block, so its mean does not depend on partitions; one of ten spectra has samples
    pools = by_block(sound, recording, n * AT_ONCE, n // 2, n // 2, work, "pool long, bands array<double>, peak double")
    own = pools.groupBy(recording).agg(F.max("peak").alias("peak"), F.array_sort(F.collect_list(F.struct("pool", "bands"))).alias("p"))
    level = F.when(F.col("peak") > 0, F.col("peak") * F.col("peak")).otherwise(1.0)
    contour = F.transform("p", lambda p: F.transform(p["bands"], lambda b: F.log10(b / F.col("level") + TINY)))
    c = own.withColumn("level", level).select(recording, contour.alias("c"))
    c = c.withColumns({"lo": F.array_min(F.transform("c", F.array_min)), "hi": F.array_max(F.transform("c", F.array_max))})
    step = lambda x: F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-12) * LEVELS), F.lit(LEVELS - 1))
    row = lambda k: F.array_join(F.transform("c", lambda p: F.concat(F.lit("0"), step(F.get(p, k)).cast("string"))), "")
    levels = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PRINT_BANDS - 1)), row), "")
    return c.select(recording, F.sha1(F.unhex(F.concat(_long_bytes(F.lit(PRINT_BANDS)), _long_bytes(F.size("c")), levels))).alias("print"))


def _long_bytes(x: Column) -> Column:
    """Hex of a number's eight bytes, the lowest first."""
    h = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.concat(*(F.substring(h, k, 2) for k in range(15, 0, -2)))


def _cosines(bands: int, kept: int) -> np.ndarray:
    """The first rows of the orthonormal cosine transform."""
    k, i = np.arange(kept)[:, None], np.arange(bands)[None, :]
    return np.cos(np.pi * k * (2 * i + 1) / (2 * bands)) * np.where(k == 0, (1 / bands) ** 0.5, (2 / bands) ** 0.5)


def voice_statistics(sound: DataFrame, recording: str, rate: int) -> DataFrame:
    """``(recording, vector)``: means and deviations of cepstra and of their steps, as a direction.

    Spectra of 25 ms each 10 ms; the loudness coefficient is zeroed and each of the four parts is
    centred, so the shape of the spectrum counts.  Zeros for recordings under 0.2 s, without
    change, or of a rate too low.  Tasks add up counts, sums and squares.
    """
    n, hop = max(round(VOICE_S * rate), 16), max(round(VOICE_STEP_S * rate), 1)
    usable = rate / 2.0 > VOICE_LOW_HZ
    fb = mel_filters(VOICE_BANDS, VOICE_LOW_HZ, np.linspace(0.0, rate / 2.0, n // 2 + 1)) if usable else np.zeros((VOICE_BANDS, n // 2 + 1))
    turn = _cosines(VOICE_BANDS, VOICE_KEPT)

    def work(x, first, block, length):
        spectra = (length - n) // hop + 1 if length >= n else 0
        mine = max(min(spectra - block * AT_ONCE, AT_ONCE), 0)
        ahead = min(mine + 1, max(spectra - block * AT_ONCE, 0))  # the step to the next block's first belongs here
        rows = np.lib.stride_tricks.sliding_window_view(x, n)[::hop][:ahead] if ahead else np.zeros((0, n))
        c = np.log(_power(rows) @ fb.T + TINY) @ turn.T
        d = np.diff(c, axis=0)
        own, heard = c[:mine], x[: max(min(length - first, AT_ONCE * hop), 0)]
        out = {"n": [len(own)], "steps": [len(d)], "low": [float(heard.min(initial=np.inf))], "high": [float(heard.max(initial=-np.inf))], "length": [length]}
        return out | {k: [v.sum(axis=0)] for k, v in (("c", own), ("cc", own**2), ("d", d), ("dd", d**2))}

    fields = "n long, steps long, low double, high double, length long, c array<double>, cc array<double>, d array<double>, dd array<double>"
    parts = by_block(sound, recording, AT_ONCE * hop, 0, n + hop, work, fields)
    # sums by coefficient, of what every block has added up
    names = ["c", "cc", "d", "dd"]
    each = parts.select(recording, "n", "steps", "low", "high", "length", F.posexplode(F.arrays_zip(*names)).alias("k", "s")).select("*", *(F.col(f"s.{x}").alias(x) for x in names))
    sums = each.groupBy(recording, "k").agg(*(F.sum(x).alias(x) for x in ("n", "steps", *names)), F.min("low").alias("low"), F.max("high").alias("high"), F.max("length").alias("length"))
    mean = lambda x, n: F.when(F.col(n) > 0, F.col(x) / F.col(n)).otherwise(0.0)
    spread = lambda x, n: F.sqrt(F.greatest(mean(x + x, n) - mean(x, n) * mean(x, n), F.lit(0.0)))
    four = sums.select(recording, "k", F.array(mean("c", "n"), spread("c", "n"), mean("d", "steps"), spread("d", "steps")).alias("v"), (F.lit(usable) & (F.col("n") > 0) & (F.col("length") >= VOICE_LEAST_S * rate) & (F.col("high") - F.col("low") >= 1e-9)).alias("ok"))
    whole = four.groupBy(recording).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("v"), F.every("ok").alias("ok"))
    block = lambda i: F.transform("v", lambda x: F.when(x["k"] > 0, F.get(x["v"], i)).otherwise(0.0))
    centred = lambda b: F.transform(b, lambda x, k: F.when(k > 0, x - F.aggregate(b, F.lit(0.0), lambda s, y: s + y) / (VOICE_KEPT - 1)).otherwise(0.0))
    held = whole.select(recording, "ok", *(block(i).alias(f"b{i}") for i in range(4)))
    vector = F.concat(*(centred(F.col(f"b{i}")) for i in range(4)))
    return held.select(recording, F.when(F.col("ok"), vector).otherwise(F.array_repeat(F.lit(0.0), 4 * VOICE_KEPT)).alias("v")).select(recording, unit(F.col("v")).alias("vector"))


def voice_vector(x: np.ndarray, rate: int) -> np.ndarray:
    """The vector of ``voice_statistics`` of one clip that is in memory."""
    n, hop = max(round(VOICE_S * rate), 16), max(round(VOICE_STEP_S * rate), 1)
    zeros = np.zeros(4 * VOICE_KEPT)
    if rate / 2.0 <= VOICE_LOW_HZ or len(x) < max(VOICE_LEAST_S * rate, n) or np.ptp(x) < 1e-9:
        return zeros
    fb = mel_filters(VOICE_BANDS, VOICE_LOW_HZ, np.linspace(0.0, rate / 2.0, n // 2 + 1))
    c = np.log(_power(np.lib.stride_tricks.sliding_window_view(x, n)[::hop]) @ fb.T + TINY) @ _cosines(VOICE_BANDS, VOICE_KEPT).T
    d = np.diff(c, axis=0) if len(c) > 1 else np.zeros((1, VOICE_KEPT))
    parts = np.array([c.mean(0), c.std(0), d.mean(0), d.std(0)])
    parts[:, 0] = 0
    parts[:, 1:] -= parts[:, 1:].mean(axis=1, keepdims=True)
    size = np.linalg.norm(parts)
    return parts.ravel() / size if size >= 1e-8 else zeros


def frame_energies(sound: DataFrame, recording: str, rate: int, frame_ms: int = SPEECH_FRAME_MS) -> DataFrame:
    """``(recording, frame, energy)``: mean squares of whole frames."""
    n = max(frame_ms * rate // 1000, 1)

    def work(x, first, block, length):
        mine = max(min(length // n - block * AT_ONCE, AT_ONCE), 0)
        e = (x[: mine * n].reshape(mine, n) ** 2).mean(axis=1) + TINY
        return {"frame": np.arange(mine) + block * AT_ONCE, "energy": e}

    return by_block(sound, recording, n * AT_ONCE, 0, 0, work, "frame long, energy double")


def speech_frames(energies: DataFrame, recording: str, decibels: float = SPEECH_DB, loud: float = LOUD) -> DataFrame:
    """``(recording, frame, speech)``: frames less than 35 dB below the recording's loud ones.

    Loud is the 95th percentile of its energies, between the two neighbours in rank.
    """
    order = Window.partitionBy(recording).orderBy("energy", "frame")
    ranked = energies.withColumns({"_r": F.row_number().over(order) - 1, "_n": F.count("*").over(Window.partitionBy(recording))})
    at = (F.col("_n") - 1) * loud
    share = at - F.floor(at)
    part = F.when(F.col("_r") == F.floor(at), F.col("energy") * (1 - share)).when(F.col("_r") == F.floor(at) + 1, F.col("energy") * share)
    level = ranked.groupBy(recording).agg(F.sum(part).alias("_loud"))
    speech = 10 * F.log10(F.col("energy") / (F.col("_loud") + TINY)) > decibels
    return energies.join(level, recording).select(recording, "frame", speech.alias("speech"))


def speech_windows(speech: DataFrame, durations: DataFrame, recording: str, window_ms: int = 2000, hop_ms: int = 750, frame_ms: int = SPEECH_FRAME_MS) -> DataFrame:
    """``(recording, window, start, end)`` in ms of the windows whose middle frame is speech.

    ``durations`` are ``(recording, ms)``.  Windows begin each ``hop_ms`` while they end no more
    than a hop after the recording, where they are cut; ``window`` numbers all of them.
    """
    last = F.floor((F.col("ms") + hop_ms - window_ms) / hop_ms)
    d = durations.where(last >= 0).select(recording, "ms", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("window"))
    d = d.select(recording, "window", (F.col("window") * hop_ms).alias("start"), F.least(F.col("window") * hop_ms + window_ms, F.col("ms")).alias("end"))
    middle = F.floor((F.col("start") + window_ms / 2) / frame_ms)
    return d.withColumn("frame", middle.cast("long")).join(speech.where("speech"), [recording, "frame"]).select(recording, "window", "start", "end")


def clips(sound: DataFrame, spans: DataFrame, recording: str, item: str, rate: int) -> DataFrame:
    """Each span of a recording as a recording of its own: ``(clip, start, samples)``.

    ``spans`` are ``(recording, item, start, end)`` in ms, a clip is named by both keys; pieces are
    sent to every span that they reach into, found by bins of a second.
    """
    from_, to = F.floor(F.col("start") * rate / 1000).cast("long"), F.floor(F.col("end") * rate / 1000).cast("long")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / rate), F.floor(F.greatest(b - 1, a) / rate))).alias("_bin")
    s = spans.select(recording, item, from_.alias("_f"), to.alias("_t")).select("*", bins(F.col("_f"), F.col("_t")))
    end = F.col("start") + F.size("samples")
    p = sound.select(recording, "start", "samples", bins(F.col("start"), end))
    both = s.join(p, [recording, "_bin"]).where((F.col("start") < F.col("_t")) & (end > F.col("_f")))
    both = both.where(F.col("_bin") == F.floor(F.greatest("start", "_f") / rate))
    lo = F.greatest(F.col("_f") - F.col("start"), F.lit(0))
    hi = F.least(F.col("_t") - F.col("start"), F.size("samples"))
    part = F.slice("samples", (lo + 1).cast("int"), (hi - lo).cast("int"))
    return both.select(F.struct(recording, item).alias("clip"), (F.col("start") + lo - F.col("_f")).alias("start"), part.alias("samples"))
