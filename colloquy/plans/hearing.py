"""Named queries of sound: fingerprints, resampling, voices and speech, and their SQL.

The tables hold no sound, so vectors stand in for it: a hundred neighbours are one recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import sound
from colloquy.plans.catalog import _t

VECTORS, SIZE, RATE, SLOWER = 100, 64, 640, 480
#: Decibels under the loud frames: neighbouring vectors are about as loud as each other.
NEAR_DB = -1.0


def recordings(spark, d) -> DataFrame:
    """Each vector's components as samples, one after the other."""
    e = _t(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / VECTORS).cast("long").alias("rec"), (F.col("vec_id") % VECTORS * SIZE).alias("start"), F.col("embedding").cast("array<double>").alias("samples"))


def sound_fingerprints(spark, d):
    return sound.fingerprints(recordings(spark, d), "rec", RATE)


def sound_decontaminated(spark, d):
    """Recordings that sound like none of those held out, among them softer stereo copies of these."""
    every = recordings(spark, d)
    held = every.where("rec % 5 = 0")
    side = F.explode(F.array(F.lit(0.125), F.lit(0.375))).alias("level")
    stereo = held.select((F.col("rec") + 1_000_000).alias("rec"), "start", "samples", side).select("rec", "start", F.transform("samples", lambda x: x * F.col("level")).alias("samples"))
    prints = sound.fingerprints(every.unionByName(sound.downmixed(stereo, "rec")), "rec", RATE)
    known = sound.fingerprints(held, "rec", RATE).select("print").distinct()
    return prints.join(known, "print", "left_anti").select("rec")


def resampled_sound(spark, d):
    slow = sound.resampled(recordings(spark, d), "rec", RATE, SLOWER)
    energy = F.aggregate(F.transform("samples", lambda x: x * x), F.lit(0.0), lambda s, x: s + x)
    return slow.groupBy("rec").agg(F.max(F.col("start") + F.size("samples")).alias("length"), F.round(F.sum(energy), 4).alias("energy"))


def voice_vectors(spark, d):
    return sound.voice_statistics(recordings(spark, d), "rec", RATE)


def speech_windows(spark, d):
    """Windows of 2 s, one each 750 ms, whose middle frame is loud."""
    every = recordings(spark, d)
    ms = sound.lengths(every, "rec").select("rec", F.floor(F.col("length") * 1000 / RATE).alias("ms"))
    speech = sound.speech_frames(sound.frame_energies(every, "rec", RATE), "rec", NEAR_DB)
    return sound.speech_windows(speech, ms, "rec")


_FRAME = sound.SPEECH_FRAME_MS * RATE // 1000
_X = f"(SELECT vec_id // {VECTORS} AS rec, vec_id % {VECTORS} * {SIZE} + generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_UP, _DOWN, _HALF = 3, 4, 40
_BESSEL = "list_sum(list_transform(range(0, 30), lambda n: (({x}) / 4) ** n / (factorial(n::INT)::DOUBLE ** 2)))"

SQL = {
    "sound_decontaminated": f"SELECT DISTINCT vec_id // {VECTORS} AS rec FROM embeddings WHERE vec_id // {VECTORS} % 5 <> 0",
    "resampled_sound": f"""WITH x AS MATERIALIZED (SELECT * FROM {_X}), n AS (SELECT rec, max(i) + 1 AS n FROM x GROUP BY rec),
        k AS (SELECT k, CASE WHEN k = 0 THEN 1 ELSE sin(pi() * k / {_DOWN}) / (pi() * k / {_DOWN}) END * {_BESSEL.format(x=f"25 * (1 - (k / {_HALF}.0) ** 2)")} AS h FROM (SELECT unnest(range(-{_HALF}, {_HALF + 1})) AS k)),
        h AS MATERIALIZED (SELECT k, h * {_UP} / sum(h) OVER () AS h FROM k),
        m AS (SELECT rec, unnest(range(0, (n * {_UP} + {_DOWN - 1}) // {_DOWN})) AS m FROM n),
        y AS (SELECT m.rec, m.m, sum(x.x * h.h) AS y FROM m JOIN h ON (m.m * {_DOWN} - h.k) % {_UP} = 0 JOIN x ON x.rec = m.rec AND x.i = (m.m * {_DOWN} - h.k) // {_UP} AND m.m * {_DOWN} - h.k >= 0 GROUP BY m.rec, m.m)
        SELECT rec, max(m) + 1 AS length, round(sum(y * y), 4) AS energy FROM y GROUP BY rec""",
    "speech_windows": f"""WITH x AS MATERIALIZED (SELECT * FROM {_X}), n AS (SELECT rec, max(i) + 1 AS n FROM x GROUP BY rec),
        e AS MATERIALIZED (SELECT rec, i // {_FRAME} AS frame, sum(x * x) / {_FRAME} + {sound.TINY} AS e FROM x JOIN n USING (rec) WHERE i // {_FRAME} < n // {_FRAME} GROUP BY ALL),
        l AS (SELECT rec, quantile_cont(e, {sound.LOUD}) AS loud FROM e GROUP BY rec),
        w AS (SELECT rec, unnest(range(0, (n * 1000 // {RATE} + 750 - 2000) // 750 + 1)) AS "window", n * 1000 // {RATE} AS ms FROM n)
        SELECT w.rec, "window", "window" * 750 AS "start", least("window" * 750 + 2000, ms) AS "end" FROM w JOIN l USING (rec) JOIN e ON e.rec = w.rec AND e.frame = ("window" * 750 + 1000) // {sound.SPEECH_FRAME_MS}
        WHERE 10 * log10(e / (loud + {sound.TINY})) > {NEAR_DB}""",
}
QUERIES: dict = {name: globals()[name] for name in [*SQL, "sound_fingerprints", "voice_vectors"]}
