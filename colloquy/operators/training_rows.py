"""Rows of training sets: sampled windows, what a token may hear, weights, ids, rounded and quantised numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tries of a window that holds two segments or more.
TRIES = 8
SPEAKER_MARK = r"\[S\d+\]"


def rounded(x: Column, digits: int = 2) -> Column:
    """A number to so many digits as its exact binary value says, halves to the even digit.

    The product with the power of ten is taken with its rounding error, so 2.675, which is a
    little less, gives 2.67.  Numbers of 2^40 or more, infinite ones and NaN stay as they are.
    """
    ten = 10.0**digits
    p = x * ten
    big = x * 134217729.0  # 2^27 + 1 splits a double in two halves that multiply without error
    high = big - (big - x)
    error = (high * ten - p) + (x - high) * ten
    n = F.floor(p)
    over = (p - n - 0.5) + error
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(F.abs(n % 2))
    return F.when(F.abs(x) < float(1 << 40), (n + up) / ten).otherwise(x)


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the keys' digest, the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *keys).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def window_samples(segments: DataFrame, durations: DataFrame, key: str, order: str, most_ms: int, seed: str = "") -> DataFrame:
    """``(key, offset, order, start, end, speaker, text)``: a window of each recording's segments.

    The window is ``most_ms`` long and begins anywhere in ``durations(key, ms)``; up to eight
    places are tried until two whole segments or more lie in it.  Times count from its start and
    speakers are numbered from 1 as they first appear.  A recording of no more than ``most_ms`` is
    its own window; one whose last try holds no segment has no rows.
    """
    room = F.col("ms") - most_ms
    tries = durations.where("ms is not null").select(key, "ms", F.explode(F.sequence(F.lit(0), F.when(room <= 0, 0).otherwise(TRIES - 1))).alias("try"))
    at = F.when(room <= 0, 0).otherwise(F.floor(uniform(F.lit(seed), F.col(key).cast("string"), F.col("try").cast("string")) * (room + 1)))
    tries = tries.select(key, "try", at.cast("long").alias("offset"), (room <= 0).alias("_whole"))
    inside = segments.join(tries, key).where((F.col("start") >= F.col("offset")) & (F.col("end") <= F.col("offset") + most_ms))
    n = inside.groupBy(key, "try").agg(F.count("*").alias("_n"))
    good = F.col("_whole") | (F.col("_n") >= 2) | (F.col("try") == TRIES - 1)
    chosen = tries.join(n, [key, "try"], "left").where(good).groupBy(key).agg(F.min_by("try", "try").alias("try"))
    rows = inside.join(chosen, [key, "try"])
    first = rows.groupBy(key, "speaker").agg(F.min(F.struct("start", order)).alias("_first"))
    number = first.select(key, F.col("speaker"), F.row_number().over(Window.partitionBy(key).orderBy("_first")).alias("_n"))
    return rows.join(number, [key, "speaker"]).select(key, "offset", order, (F.col("start") - F.col("offset")).alias("start"), (F.col("end") - F.col("offset")).alias("end"), F.col("_n").alias("speaker"), "text")


def marked_text(segments: Column) -> Column:
    """``[start][Sxx]text[end]`` of segments with numbers as speakers and seconds as times."""
    return F.array_join(F.transform(segments, lambda s: F.format_string("[%.2f][S%02d]%s[%.2f]", s["start"], s["speaker"], s["text"], s["end"])), "")


def spans_of(text: Column, pattern: str) -> Column:
    """``array<struct<from, to>>``: where the pattern's matches lie, in letters from 0."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    sizes = F.zip_with(F.transform(F.slice(between, 1, F.size(found)), F.length), F.transform(found, F.length), lambda a, b: F.struct(a.alias("gap"), b.alias("own")))

    def add(held: Column, x: Column) -> Column:
        at = F.coalesce(F.get(held, F.size(held) - 1)["to"], F.lit(0)) + x["gap"]
        return F.concat(held, F.array(F.struct(at.alias("from"), (at + x["own"]).alias("to"))))

    return F.aggregate(sizes, F.array().cast("array<struct<from:int,to:int>>"), add)


def mark_weights(offsets: Column, text: Column, weight: float, pattern: str = SPEAKER_MARK) -> Column:
    """A weight for each token ``struct<from, to>``: ``weight`` where it touches a mark, else 1; one more 1 for the end."""
    spans = spans_of(text, pattern)
    hit = lambda t, s: (t["from"] < t["to"]) & F.exists(s, lambda m: (t["from"] < m["to"]) & (t["to"] > m["from"]))
    # the spans are bound once a text
    of = F.transform(F.array(spans), lambda s: F.transform(offsets, lambda t: F.when(hit(t, s), float(weight)).otherwise(1.0)))
    return F.concat(F.get(of, F.lit(0)), F.array(F.lit(1.0)))


def heard_from(tokens: DataFrame, segments: DataFrame, key: str, window_ms: int, step_ms: int) -> DataFrame:
    """``(key, token, start, first_frame)``: the first frame of sound that a token may still hear.

    ``tokens`` are ``(key, token, at)`` with their first letter's place in the recording's text,
    ``segments`` ``(key, at, start)`` with theirs.  A token belongs to the last segment that begins
    at or before it; frames of ``step_ms`` that begin more than ``window_ms`` before the segment
    are gone by then.  A token before every segment belongs to the first.
    """
    rows = segments.select(key, "at", F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("token"), F.col("start").alias("_s")).unionByName(
        tokens.select(key, "at", F.lit(1).alias("_kind"), F.col("token").cast("long").alias("token"), F.lit(None).cast("long").alias("_s"))
    )
    upto = Window.partitionBy(key).orderBy("at", "_kind", "token", "_s").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("_kind") == 0, F.struct("at", "_s"))).over(Window.partitionBy(key))
    start = F.coalesce(F.last("_s", True).over(upto), first["_s"])
    out = rows.withColumn("start", start).where("_kind = 1")
    return out.select(key, "token", "start", F.greatest(F.ceil((F.col("start") - window_ms) / step_ms), F.lit(0)).alias("first_frame"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of texts and lists of texts, one after the other; null counts as empty."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def seed_of(name: Column) -> Column:
    """The first eight bytes of a name's SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(F.coalesce(name, F.lit("")), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def layer_pairs(teacher: int, student: int) -> list[tuple[int, int]]:
    """Layers of a deep model for each layer of a shallow one, evenly apart, the last ones paired."""
    if min(teacher, student) <= 0:
        raise ValueError("both models have layers")
    even = [min(max(round((i + 1) * teacher / student) - 1, 0), teacher - 1) for i in range(student)]
    return [*((t, i) for i, t in enumerate(even[:-1])), (teacher - 1, student - 1)]


def quantised(weights: Column, bits: int = 4, block: int = 32) -> Column:
    """A row of floats on ``2^bits - 1`` levels, symmetric, with a scale for each block.

    The scale is the greatest size over the outermost level, or with two bits the mean size, in
    single precision and 1e-8 at least; a short last block counts as filled up with zeros.
    """
    top = float((1 << (bits - 1)) - 1)
    single = lambda x: x.cast("float")
    sizes = lambda b: F.transform(b, lambda x: F.abs(x.cast("double")))

    def one(b: Column) -> Column:
        raw = F.aggregate(sizes(b), F.lit(0.0), lambda s, x: s + x) / block if bits <= 2 else F.array_max(sizes(b)) / top
        scale = F.greatest(single(raw), single(F.lit(1e-8))).cast("double")
        level = lambda x, s: F.least(F.greatest(F.rint(single(x.cast("double") / s).cast("double")), F.lit(-top)), F.lit(top)) + 0.0
        return F.get(F.transform(F.array(scale), lambda s: F.transform(b, lambda x: single(level(x, s) * s))), F.lit(0))

    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(weights) / block) - 1, F.lit(0)).cast("int"))
    return F.when(F.size(weights) > 0, F.flatten(F.transform(starts, lambda k: one(F.slice(weights, k * block + 1, F.lit(block)))))).otherwise(F.array().cast("array<float>"))


def importance(rows: DataFrame, batch: str, unit: str, value: str) -> DataFrame:
    """``(unit, importance)``: the mean over batches of a unit's mean size in the batch."""
    by = rows.groupBy(batch, unit).agg(F.avg(F.abs(F.col(value).cast("double"))).alias("_m"))
    return by.groupBy(unit).agg(F.avg("_m").alias("importance"))


def features(prompt: list[int], target: Column, end: int | None) -> Column:
    """``struct(input_ids, labels, attention_mask)``: a prompt that is not learnt, then the target and its end."""
    own = F.concat(target, F.array(F.lit(end))) if end is not None else target
    before = F.array(*map(F.lit, prompt)).cast("array<int>")
    ids = F.concat(before, own.cast("array<int>"))
    return F.struct(ids.alias("input_ids"), F.concat(F.array_repeat(F.lit(-100), len(prompt)), own.cast("array<int>")).alias("labels"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"))


def mark_ids(vocabulary: DataFrame, token: str, id_: str, pattern: str) -> DataFrame:
    """Ids of the tokens that only consist of what marks are made of."""
    return vocabulary.where(F.regexp_like(F.trim(token), F.lit(pattern))).select(id_).distinct()
