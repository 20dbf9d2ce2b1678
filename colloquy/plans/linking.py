"""Named queries of windows cut at pauses, linked speakers and their sweeps, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import components, constrained, cursor, linkage, speaker_count, vectors
from colloquy.plans.catalog import _t, segments
from colloquy.plans.records import OVERLAP_MS, WINDOW_MS, windowed

#: Frames of a window and of its end in which it may be cut, those of a pause, and the least that
#: begins a window: 45 s, 5 s, 0.4 s and 1 s of 0.1 s.
WINDOW, SNAP, POOL, LEAST = 450, 50, 4, 10
#: Vectors of one made-up recording of the sweeps, and of the others.
FEW, MANY = 10, 100
THRESHOLDS = [0.3, 0.5, 0.7, 0.8, 0.9, 1.0, 1.1]
STEP = WINDOW_MS - OVERLAP_MS


def frame_energies(spark, d) -> DataFrame:
    """Conversations as sound: each letter is a frame, blanks are quiet and rare letters loud."""
    c = _t(spark, d, "conversations")
    letters = F.split(F.coalesce("text", F.lit("")), "").alias("l")
    said = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("text"))
    rows = said.select("conv_id", F.posexplode(letters).alias("place", "l"))
    return rows.where("l <> ''").select("conv_id", F.col("place").cast("long").alias("place"), F.when(F.col("l") == " ", 0).otherwise(F.ascii("l") % 97).cast("long").alias("energy"))


def pause_windows(spark, d):
    return cursor.pause_windows(frame_energies(spark, d), "conv_id", "place", "energy", WINDOW, SNAP, POOL, LEAST)


def must_link_groups(spark, d):
    """Speakers of overlapping windows who are one, by the time they share."""
    return components.linked_units(windowed(segments(spark, d)), "conv_id", WINDOW_MS, STEP, 1000)


def _embeddings(spark, d, size: int) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / size).cast("long").alias("rec"), "vec_id", "embedding", "label")


def merge_heights(spark, d):
    """Heights of a recording's merges from the lowest on."""
    tree = linkage.dendrogram(_embeddings(spark, d, FEW), "rec", "vec_id", "embedding").where("height is not null")
    heights = F.array_sort(F.collect_list("height"))  # one a vector of a recording
    return tree.groupBy("rec").agg(heights.alias("h")).select("rec", F.posexplode("h").alias("step", "h")).select("rec", (F.col("step") + 1).alias("step"), F.round("h", 6).alias("height"))


def linkage_sweep(spark, d):
    """Clusters and the largest one of each recording at every threshold."""
    got = linkage.cuts(linkage.dendrogram(_embeddings(spark, d, FEW), "rec", "vec_id", "embedding"), "rec", "vec_id", THRESHOLDS)
    by = got.groupBy("rec", "threshold", "cluster").agg(F.count("*").alias("n"))
    return by.groupBy("rec", "threshold").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


def _swept(spark, d, method: str, pooled: bool) -> DataFrame:
    """Each vector as a segment of 1 to 5 s; ten neighbours are a window, its speakers known by label."""
    e = _embeddings(spark, d, MANY).withColumns({"window": F.floor(F.col("vec_id") / 10).cast("long"), "seconds": (F.col("vec_id") % 5 + 1).cast("double")})
    unit = ["window", "label"] if pooled else ["vec_id"]
    if pooled:
        own = vectors.centroids(e.withColumn("_u", F.struct("rec", *unit)), "_u", "embedding", F.greatest("seconds", F.lit(0.1))).select("_u.*", F.col("centroid").alias("vector"))
    else:
        own = e.select("rec", "vec_id", F.col("embedding").alias("vector"))
    got = linkage.swept_segments(e, own, "rec", "vec_id", unit, method, THRESHOLDS, ["label"])
    right = got.groupBy("rec", "threshold", "speaker", "label").agg(F.count("*").alias("n"))
    most = right.groupBy("rec", "threshold", "speaker").agg(F.max("n").alias("hit"), F.sum("n").alias("n"))
    return most.groupBy("threshold").agg(F.count("*").alias("speakers"), F.round(F.sum("hit") / F.sum("n"), 6).alias("purity"))


def swept_labels(spark, d):
    """Speakers and their purity at every threshold, by segments or pooled units and by linkage."""
    out = None
    for method in ("average", "complete", "ward"):
        for name, pooled in (("segment", False), ("unit", True)):
            got = _swept(spark, d, method, pooled).select(F.lit(method).alias("method"), F.lit(name).alias("by"), "*")
            out = got if out is None else out.unionByName(got)
    return out


def global_speakers(spark, d):
    """Vectors as segments of a recording of ten, every seventh too short to count."""
    e = _embeddings(spark, d, FEW).select("rec", "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 3, 0.1).otherwise(2.0).alias("seconds"), F.lit("?").alias("speaker"))
    got = linkage.global_speakers(e, "rec", "vec_id", "seconds", "embedding", 0.9)
    return got.groupBy("rec", "speaker").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))


def constrained_speakers(spark, d):
    """Ten neighbouring vectors are a window that tells three voices apart by their labels."""
    e = _embeddings(spark, d, MANY).withColumns({
        "window": F.floor(F.col("vec_id") / 10).cast("long"), "tag": F.concat(F.lit("S0"), (F.col("label") % 3 + 1).cast("string")), "seconds": (F.col("vec_id") % 4 + 1).cast("double"),
        "vector": F.when(F.col("vec_id") % 37 != 5, F.col("embedding")),
    })
    units = constrained.pooled_units(e, "rec", "window", "tag", "vec_id", "seconds", "vector")
    return constrained.constrained_speakers(units, "rec", "window", "tag")


def estimated_speakers(spark, d):
    """Speakers that each recording of a hundred vectors seems to have, by both ranges."""
    e = _embeddings(spark, d, MANY)
    wide = speaker_count.estimated_count(e, "rec", "embedding").withColumnRenamed("k", "of_windows")
    return wide.join(speaker_count.estimated_count(e, "rec", "embedding", speaker_count.MOST_UNITS).select("rec", F.col("k").alias("of_units")), "rec")


def diarized_regions(spark, d):
    """Vectors as windows of 2 s, one each 750 ms, a pause after every twenty."""
    at = (F.col("vec_id") % MANY) * 750 + F.floor(F.col("vec_id") % MANY / 20) * 5000
    e = _embeddings(spark, d, MANY).withColumn("start", at).withColumn("end", at + 2000)
    return speaker_count.diarized(e, "rec", "vec_id", "embedding", 750)


_SEGS = """(SELECT conv_id, turn, role AS speaker, e - l AS s, e FROM (SELECT *, CAST(sum(l) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e
    FROM (SELECT *, CAST(greatest(length(text) * 80, 300) AS BIGINT) AS l FROM conversations)))"""
_WIN = f"""(SELECT conv_id, o AS "offset", s AS "start", least(e, o + {WINDOW_MS}) AS "end", 'w' || (o // {STEP} % 2)::INT || '-' || speaker AS speaker
    FROM (SELECT *, unnest(range(greatest(floor((s - {WINDOW_MS}) / {STEP})::BIGINT + 1, 0), s // {STEP} + 1)) * {STEP} AS o FROM {_SEGS}))"""
#: Greedy average linkage on cosine distance: each step merges the closest pair of every recording.
_MERGED = f"""st AS (
    SELECT vec_id // {FEW} AS rec, 0 AS step, vec_id AS id, 1 AS n, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v, NULL::DOUBLE AS h FROM embeddings
    UNION ALL SELECT s.rec, s.step + 1, s.id, CASE WHEN s.id = p.a THEN s.n + o.n ELSE s.n END, CASE WHEN s.id = p.a THEN list_transform(list_zip(s.v, o.v), lambda z: z[1] + z[2]) ELSE s.v END, p.d
    FROM st s JOIN (SELECT a.rec, a.id AS a, b.id AS b, 1 - list_inner_product(a.v, b.v) / (a.n * b.n) AS d FROM st a JOIN st b ON a.rec = b.rec AND a.id < b.id QUALIFY row_number() OVER (PARTITION BY a.rec ORDER BY d, a.id, b.id) = 1) p ON s.rec = p.rec
    LEFT JOIN st o ON o.rec = p.rec AND o.id = p.b WHERE s.id <> p.b)"""

SQL = {
    "pause_windows": f"""WITH RECURSIVE c AS (SELECT conv_id, string_split(string_agg(coalesce(text, ''), ' ' ORDER BY turn), '') AS l FROM conversations GROUP BY conv_id),
        e AS (SELECT conv_id, list_transform(list_filter(l, lambda x: x <> ''), lambda x: CASE WHEN x = ' ' THEN 0 ELSE unicode(x) % 97 END) AS e FROM c),
        q AS (SELECT conv_id, len(e) AS n, list_transform(range(1, len(e) - {POOL - 2}), lambda i: list_sum(e[i:i + {POOL - 1}])::BIGINT) AS q FROM e),
        w AS (SELECT conv_id, n, q, 0 AS "window", 0::BIGINT AS "start", NULL::BIGINT AS cut FROM q
        UNION ALL SELECT conv_id, n, q, "window" + 1, "start" + {WINDOW - SNAP} + list_position(q["start" + {WINDOW - SNAP + 1}:"start" + {WINDOW - POOL + 1}], list_min(q["start" + {WINDOW - SNAP + 1}:"start" + {WINDOW - POOL + 1}])) - 1 + {POOL // 2},  NULL
            FROM w WHERE "start" + {WINDOW} < n AND n - "start" >= {LEAST}),
        k AS (SELECT conv_id, "window", "start", n, coalesce(lead("start") OVER (PARTITION BY conv_id ORDER BY "window"), n) AS cut, "start" + {WINDOW} >= n AS last FROM w)
        SELECT conv_id, "window", "start", cut, last FROM k WHERE n - "start" >= {LEAST}""",
    "must_link_groups": f"""WITH RECURSIVE w AS MATERIALIZED (SELECT * FROM {_WIN}), l AS MATERIALIZED (
            SELECT a.conv_id, a."offset" AS o, a.speaker AS a, b.speaker AS b FROM w a JOIN w b ON a.conv_id = b.conv_id AND b."offset" = a."offset" + {STEP}
            WHERE least(a."end", b."end", a."offset" + {WINDOW_MS}) > greatest(a."start", b."start", a."offset" + {STEP})
            GROUP BY ALL HAVING sum(least(a."end", b."end", a."offset" + {WINDOW_MS}) - greatest(a."start", b."start", a."offset" + {STEP})) > 1000),
        u AS (SELECT DISTINCT conv_id, "offset" AS o, speaker FROM w),
        ends AS (SELECT conv_id, o, a, o + {STEP} AS o2, b FROM l UNION ALL SELECT conv_id, o + {STEP}, b, o, a FROM l),
        r AS (SELECT conv_id, o, speaker, o AS o2, speaker AS s2 FROM u UNION SELECT r.conv_id, r.o, r.speaker, x.o2, x.b FROM r JOIN ends x ON x.conv_id = r.conv_id AND x.o = r.o2 AND x.a = r.s2)
        SELECT conv_id, o AS "offset", speaker, min((o2, s2))[1] AS first_offset, min((o2, s2))[2] AS first_speaker FROM r GROUP BY conv_id, o, speaker""",
    "merge_heights": f"WITH RECURSIVE {_MERGED} SELECT DISTINCT rec, step, round(h, 6) AS height FROM st WHERE step > 0",
    "linkage_sweep": f"""WITH RECURSIVE {_MERGED}, t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
        k AS (SELECT st.rec, threshold, max(CASE WHEN coalesce(h, -1) <= threshold THEN step END) AS step FROM st, t GROUP BY ALL)
        SELECT k.rec, threshold, count(*) AS clusters, max(n)::BIGINT AS largest FROM k JOIN st USING (rec, step) GROUP BY k.rec, threshold""",
}
SQL["global_speakers"] = f"""WITH RECURSIVE {_MERGED.replace("FROM embeddings", "FROM embeddings WHERE vec_id % 7 <> 3")},
    k AS (SELECT rec, max(CASE WHEN coalesce(h, -1) <= 0.9 THEN step END) AS step FROM st GROUP BY rec)
    SELECT rec, printf('S%02d', row_number() OVER (PARTITION BY rec ORDER BY id)) AS speaker, id AS first, n::BIGINT AS n FROM st JOIN k USING (rec, step)"""
ROWS_ONLY = ["swept_labels", "constrained_speakers", "estimated_speakers", "diarized_regions"]
QUERIES: dict = {name: globals()[name] for name in [*SQL, *ROWS_ONLY]}
