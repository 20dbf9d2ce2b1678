"""Named queries of fused segments, gates, health and the rows of training sets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators import fusion, scoring, training_rows
from colloquy.plans.catalog import _t, perturbed, segments
from colloquy.plans.records import _PLAIN, _marked
from colloquy.sources import generated

#: Ms before the first segment; ms of a sampled window and of what a token may hear; seconds of a
#: labelled window; letters of a token.
LATE_MS, SAMPLE_MS, HEARD_MS, STEP_MS, LABELLED_S, LETTERS = 20_000, 120_000, 20_000, 80, 200.0, 3


def _meetings(spark, d):
    s = segments(spark, d).withColumns({c: F.col(c) + LATE_MS for c in ("start", "end")})
    ms = s.groupBy("conv_id").agg(F.floor(F.max("end") * 9 / 10).alias("ms"))
    return fusion.fused(s, perturbed(s), ms, "conv_id", "pos")


def fused_meetings(spark, d):
    kept = _meetings(spark, d)[0]
    return kept.select("conv_id", "pos", "start", "end", F.col("speaker").cast("long").alias("speaker"))


def fusion_counts(spark, d):
    return _meetings(spark, d)[1]


def label_gates(spark, d):
    """Marked conversations as labelled windows; every eleventh is silent."""
    m = _marked(spark, d, True)
    rms = (F.col("conv_id") % 11).cast("double") / 1000
    return m.select("conv_id", fusion.window_fate(rms, generated.marked_segments(F.col("said")), LABELLED_S).alias("fate"))


def segment_health(spark, d):
    h = fusion.health(segments(spark, d), "conv_id")
    return h.select("conv_id", "markers", "speakers", "median_ms", F.col("max_repeat").cast("long").alias("max_repeat"), "dup_ratio", F.col("top_gram").cast("long").alias("top_gram"), F.col("chars").cast("long").alias("chars"), "monotone")


def script_leaks(spark, d):
    """Texts whose common letters are spelt as ideographs, of which two are converted."""
    raw = F.translate("text", "abcdeno", "一丁七三上下不")
    return _t(spark, d, "documents").select("doc_id", fusion.script_leak(raw, F.translate(raw, "七上", "柒尚")).alias("x")).select("doc_id", "x.*")


def timed_records(spark, d):
    """Records of which some have a start that is a number."""
    start = F.when(F.col("conv_id") % 3 == 0, F.lit('"1.5"')).when(F.col("conv_id") % 3 == 1, F.col("turn").cast("string")).otherwise(F.lit("null"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", start.alias("s")))), lambda x: F.concat(F.lit('{"start":'), x["s"], F.lit("}")))
    g = _t(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit('{"transcript":{"whisperx":['), F.array_join(items, ","), F.lit("]}}")).alias("r"))
    return g.select("conv_id", fusion.has_times(F.col("r"), "$.transcript.whisperx").alias("timed"))


# ---------------------------------------------------------------- rows of training sets
def _lengths(spark, d) -> DataFrame:
    return segments(spark, d).groupBy("conv_id").agg(F.max("end").alias("ms"))


def window_samples(spark, d):
    w = training_rows.window_samples(segments(spark, d), _lengths(spark, d), "conv_id", "pos", SAMPLE_MS)
    return w.select("conv_id", "offset", "pos", "start", "end", F.col("speaker").cast("long").alias("speaker"))


def token_horizons(spark, d):
    """Runs of three letters as tokens of a conversation; how far back each may hear."""
    s = segments(spark, d)
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    segs = s.select("conv_id", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("at"), "start")
    total = s.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).where("n > 0")
    tok = total.select("conv_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / LETTERS).cast("int"))).alias("token")).withColumn("at", F.col("token").cast("long") * LETTERS)
    h = training_rows.heard_from(tok, segs, "conv_id", HEARD_MS, STEP_MS)
    return h.groupBy("conv_id").agg(F.count("*").alias("tokens"), F.sum("first_frame").alias("hidden"), F.max("first_frame").alias("last_frame"), F.sum(F.col("first_frame") * F.col("token")).alias("mark"))


def heavy_tokens(spark, d):
    """Tokens of marked texts that touch a speaker's mark."""
    m = _marked(spark, d, True)
    n = F.floor((F.length("said") - 1) / LETTERS).cast("int")
    offsets = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct((k * LETTERS).alias("from"), F.least(k * LETTERS + LETTERS, F.length("said")).alias("to")))
    w = m.where(F.length("said") > 0).select("conv_id", training_rows.mark_weights(offsets, F.col("said"), 4.0).alias("w"))
    heavy = F.transform("w", lambda x, i: F.when(x > 1, i).otherwise(-1))
    return w.select("conv_id", F.size("w").cast("long").alias("n"), F.size(F.filter(heavy, lambda i: i >= 0)).cast("long").alias("heavy"), F.aggregate(F.filter(heavy, lambda i: i >= 0), F.lit(0).cast("long"), lambda a, i: a + i).alias("places"))


def rounded_values(spark, d):
    x = F.col("value") * F.col("event_id") / 7
    return _t(spark, d, "events").select("event_id", training_rows.rounded(x).alias("two"), training_rows.rounded(F.floor(x * 40) / 40, 1).alias("one"))


def content_seeds(spark, d):
    c = _t(spark, d, "conversations")
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], x["text"])), "")
    g = c.groupBy("conv_id").agg(turns.alias("t"), F.min("role").alias("who"))
    return g.select("conv_id", training_rows.content_hash(F.lit("talk"), F.lit("en"), F.col("t")).alias("hash"), training_rows.seed_of(F.concat("who", F.col("conv_id").cast("string"))).cast("string").alias("seed"))


def quantised_vectors(spark, d):
    """Vectors on four, three and two bits, as how far all of it is from what was."""
    e = _t(spark, d, "embeddings")
    out = None
    for bits, block in ((4, 32), (3, 24), (2, 64)):
        q = e.select("vec_id", F.lit(bits).alias("bits"), F.col("embedding").alias("x"), training_rows.quantised(F.col("embedding"), bits, block).alias("q"))
        far = F.aggregate(F.zip_with("x", "q", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
        part = q.select("vec_id", "bits", F.size(F.array_distinct("q")).cast("long").alias("levels"), F.round(far, 5).alias("far"))
        out = part if out is None else out.unionByName(part)
    return out


def unit_importance(spark, d):
    e = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 30).alias("batch"), F.posexplode("embedding").alias("k", "x"))
    i = training_rows.importance(e.withColumn("unit", F.floor(F.col("k") / 8)), "batch", "unit", "x")
    return i.select("unit", F.round("importance", 6).alias("importance"))


def feature_rows(spark, d):
    """Letters' codes as tokens behind a prompt of two."""
    ids = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda x: x != ""), lambda x: F.ascii(x))
    f = _t(spark, d, "conversations").select("conv_id", "turn", training_rows.features([5, 6], ids, 2).alias("f"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return f.select("conv_id", "turn", F.size("f.input_ids").cast("long").alias("n"), total("f.input_ids").alias("ids"), total("f.labels").alias("labels"), total("f.attention_mask").alias("mask"))


def speaker_scores(spark, d):
    s = segments(spark, d)
    return scoring.speaker_score(s, perturbed(s), "conv_id")


_S = """(SELECT conv_id, turn AS pos, role AS speaker, text, CAST(e - l AS BIGINT) AS s, e FROM (SELECT *, CAST(sum(l) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e
    FROM (SELECT *, CAST(greatest(length(text) * 80, 300) AS BIGINT) AS l FROM conversations)))"""
_FUSE = f"""s AS MATERIALIZED (SELECT conv_id, pos, speaker, text, s + {LATE_MS} AS s, e + {LATE_MS} AS e FROM {_S}),
    k AS (SELECT conv_id, greatest(coalesce(min(CASE WHEN n >= 3 THEN s END), min(s)) - 5000, 0) AS skip FROM (SELECT conv_id, s, count(*) OVER (PARTITION BY conv_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 59999 FOLLOWING) AS n FROM s) GROUP BY conv_id),
    m AS (SELECT conv_id, max(e) * 9 // 10 AS ms FROM s GROUP BY conv_id),
    w AS (SELECT conv_id, pos, s - skip AS s, e - skip AS e, ms FROM s JOIN k USING (conv_id) JOIN m USING (conv_id) WHERE trim(text) <> ''),
    t AS (SELECT conv_id, s + 40 - skip AS s, e + 90 - skip AS e, CASE WHEN pos % 5 = 3 THEN 'other' ELSE speaker END AS who FROM s JOIN k USING (conv_id)),
    o AS (SELECT w.conv_id, w.pos, who, sum(least(w.e, t.e) - greatest(w.s, t.s)) AS ms, min(t.s) AS first FROM w JOIN t ON t.conv_id = w.conv_id AND w.s < t.e AND t.s < w.e GROUP BY ALL),
    b AS (SELECT *, sum(ms) OVER (PARTITION BY conv_id, pos) AS whole FROM o QUALIFY row_number() OVER (PARTITION BY conv_id, pos ORDER BY ms DESC, first, who DESC) = 1),
    f AS (SELECT w.*, who, CASE WHEN w.s < 0 OR w.e > w.ms OR w.e <= w.s THEN 'range' WHEN w.e - w.s NOT BETWEEN 400 AND 30000 THEN 'duration'
        WHEN whole IS NULL OR b.ms < whole * 0.75 OR b.ms < (w.e - w.s) * 0.7 THEN 'overlap' ELSE 'kept' END AS fate FROM w LEFT JOIN b USING (conv_id, pos))"""
_SAID = f"""(SELECT conv_id, string_agg(printf('[%.2f]%s%s[%.2f]', s / 1000, CASE WHEN turn % 3 = 0 THEN '[' || label || ']' ELSE '' END, coalesce(text, ''), e / 1000), '' ORDER BY turn) AS said FROM {_PLAIN} GROUP BY conv_id)"""
_TIMED = r"\[(\d+(?:\.\d+)?)\]\s*(\[S\d+\])?\s*([^\[]*)\[(\d+(?:\.\d+)?)\]"

SQL = {
    "fused_meetings": f"""WITH {_FUSE}, n AS (SELECT conv_id, who, row_number() OVER (PARTITION BY conv_id ORDER BY min(pos)) - 1 AS speaker FROM f WHERE fate = 'kept' GROUP BY conv_id, who)
        SELECT conv_id, pos, s AS "start", e AS "end", speaker FROM f JOIN n USING (conv_id, who) WHERE fate = 'kept'""",
    "fusion_counts": f"""WITH {_FUSE} SELECT conv_id, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'overlap') AS drop_overlap, count(*) FILTER (fate = 'range') AS drop_range,
        count(*) FILTER (fate = 'duration') AS drop_duration, count(DISTINCT who) FILTER (fate = 'kept') AS speakers FROM f GROUP BY conv_id""",
    "label_gates": f"""WITH m AS (SELECT conv_id, list_transform(regexp_extract_all(said, '{_TIMED}', 1), lambda x: x::DOUBLE) AS a, list_transform(regexp_extract_all(said, '{_TIMED}', 4), lambda x: x::DOUBLE) AS b,
            array_to_string(list_transform(regexp_extract_all(said, '{_TIMED}', 3), lambda x: trim(x)), '') AS t FROM {_SAID}),
        c AS (SELECT *, coalesce(list_sum(list_transform(list_zip(a, b), lambda z: greatest(z[2] - z[1], 0))), 0) AS covered, string_split(regexp_replace(t, '\\s+', '', 'g'), '') AS x FROM m)
        SELECT conv_id, CASE WHEN (conv_id % 11) / 1000 < 0.001 THEN 'silent' WHEN len(a) = 0 THEN 'no_structure' WHEN covered / {LABELLED_S} < 0.75 THEN 'low_coverage' WHEN length(t) / greatest(covered, 1e-6) NOT BETWEEN 1.5 AND 12 THEN 'density'
            WHEN contains(array_to_string(list_transform(range(4, len(x) + 1), lambda i: CASE WHEN x[i] = x[i - 3] THEN '1' ELSE '0' END), ''), '111111') THEN 'loop' ELSE 'kept' END AS fate FROM c""",
    "segment_health": f"""WITH s AS MATERIALIZED (SELECT *, trim(text) AS t, s < lag(s) OVER (PARTITION BY conv_id ORDER BY pos) AS back FROM {_S}),
        p AS MATERIALIZED (SELECT conv_id, count(*) AS markers, count(DISTINCT speaker) AS speakers, quantile_cont(e - s, 0.5) AS median_ms, NOT bool_or(coalesce(back, false)) AS monotone, string_agg(t, '' ORDER BY pos) AS said FROM s GROUP BY conv_id),
        x AS (SELECT conv_id, max(k) AS max_repeat, count(*) AS kinds, sum(k) AS texts FROM (SELECT conv_id, t, count(*) AS k FROM s WHERE t <> '' GROUP BY ALL) GROUP BY conv_id),
        g AS (SELECT conv_id, max(k) AS top_gram FROM (SELECT conv_id, g, count(*) AS k FROM (SELECT conv_id, substr(said, unnest(range(1, length(said) - 11)), 12) AS g FROM p) GROUP BY ALL) GROUP BY conv_id)
        SELECT conv_id, markers, speakers, median_ms, coalesce(max_repeat, 0) AS max_repeat, coalesce(round(1 - kinds / texts, 3), 0.0) AS dup_ratio, coalesce(top_gram, 0) AS top_gram, length(said) AS chars, monotone FROM p LEFT JOIN x USING (conv_id) LEFT JOIN g USING (conv_id)""",
    "script_leaks": "SELECT doc_id, length(regexp_replace(text, '[^abcdeno一-鿿]', '', 'g')) AS cjk, length(regexp_replace(text, '[^ce七上]', '', 'g')) AS changed FROM documents",
    "timed_records": "SELECT DISTINCT conv_id, conv_id % 3 = 1 AS timed FROM conversations",
    "window_samples": f"""WITH s AS MATERIALIZED (SELECT * FROM {_S}), n AS (SELECT conv_id, max(e) AS ms FROM s GROUP BY conv_id),
        t AS MATERIALIZED (SELECT conv_id, ms, k, CASE WHEN ms <= {SAMPLE_MS} THEN 0 ELSE floor(('0x' || substr(md5(':' || conv_id || ':' || k), 1, 8))::BIGINT / 4294967296 * (ms - {SAMPLE_MS} + 1))::BIGINT END AS o FROM (SELECT *, unnest(range(0, CASE WHEN ms <= {SAMPLE_MS} THEN 1 ELSE 8 END)) AS k FROM n)),
        i AS MATERIALIZED (SELECT s.*, t.k, t.o, ms FROM s JOIN t USING (conv_id) WHERE s >= o AND e <= o + {SAMPLE_MS}),
        c AS (SELECT t.conv_id, min(t.k) AS k FROM t LEFT JOIN (SELECT conv_id, k, count(*) AS n FROM i GROUP BY ALL) x ON x.conv_id = t.conv_id AND x.k = t.k WHERE ms <= {SAMPLE_MS} OR n >= 2 OR t.k = 7 GROUP BY t.conv_id),
        r AS (SELECT i.* FROM i JOIN c USING (conv_id, k)), f AS (SELECT conv_id, speaker, row_number() OVER (PARTITION BY conv_id ORDER BY min((s, pos))) AS who FROM r GROUP BY conv_id, speaker)
        SELECT conv_id, o AS "offset", pos, s - o AS "start", e - o AS "end", who AS speaker FROM r JOIN f USING (conv_id, speaker)""",
    "token_horizons": f"""WITH s AS (SELECT conv_id, s, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place, sum(length(text)) OVER (PARTITION BY conv_id) AS n FROM {_S}),
        k AS (SELECT conv_id, unnest(range(0, (n + {LETTERS - 1}) // {LETTERS})) AS token FROM (SELECT DISTINCT conv_id, n::BIGINT AS n FROM s)),
        j AS (SELECT k.conv_id, token, max(s.s) AS s FROM k JOIN s ON s.conv_id = k.conv_id AND s.place <= token * {LETTERS} GROUP BY ALL), h AS (SELECT *, greatest(ceil((s - {HEARD_MS}) / {STEP_MS}), 0)::BIGINT AS f FROM j)
        SELECT conv_id, count(*) AS tokens, sum(f)::BIGINT AS hidden, max(f) AS last_frame, sum(f * token)::BIGINT AS mark FROM h GROUP BY conv_id""",
    "heavy_tokens": f"""WITH m AS (SELECT conv_id, said, regexp_extract_all(said, '\\[S\\d+\\]') AS x, regexp_split_to_array(said, '\\[S\\d+\\]') AS y FROM {_SAID}),
        p AS (SELECT conv_id, length(said) AS n, list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(y[1:i], lambda v: length(v)))::BIGINT + coalesce(list_sum(list_transform(x[1:i - 1], lambda v: length(v))), 0)::BIGINT) AS a, list_transform(x, lambda v: length(v)) AS l FROM m WHERE length(said) > 0),
        h AS (SELECT conv_id, n, list_filter(range(0, (n + {LETTERS - 1}) // {LETTERS}), lambda k: len(list_filter(list_zip(a, l), lambda z: k * {LETTERS} < z[1] + z[2] AND least(k * {LETTERS} + {LETTERS}, n) > z[1])) > 0) AS h FROM p)
        SELECT conv_id, (n + {LETTERS - 1}) // {LETTERS} + 1 AS n, len(h) AS heavy, coalesce(list_sum(h), 0)::BIGINT AS places FROM h""",
    "rounded_values": "SELECT event_id, printf('%.2f', value * event_id / 7)::DOUBLE AS two, printf('%.1f', floor(value * event_id / 7 * 40) / 40)::DOUBLE AS one FROM events",
    "content_seeds": """SELECT conv_id, sha256('talken' || string_agg(role || text, '' ORDER BY turn)) AS hash, ('0x' || substr(sha256(min(role) || conv_id), 1, 16))::UBIGINT::VARCHAR AS seed FROM conversations GROUP BY conv_id""",
    "quantised_vectors": """WITH b AS (SELECT unnest([4, 3, 2]) AS bits, unnest([32, 24, 64]) AS block), v AS (SELECT vec_id, bits, block, 2 ** (bits - 1) - 1 AS top, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings, b),
        s AS (SELECT *, greatest((CASE WHEN bits <= 2 THEN sum(abs(x::DOUBLE)) OVER w / block ELSE max(abs(x::DOUBLE)) OVER w / top END)::FLOAT, 1e-8::FLOAT)::DOUBLE AS s FROM v WINDOW w AS (PARTITION BY vec_id, bits, k // block)),
        q AS (SELECT vec_id, bits, x, (least(greatest(round_even((x::DOUBLE / s)::FLOAT::DOUBLE, 0), -top), top) * s)::FLOAT AS q FROM s)
        SELECT vec_id, bits, count(DISTINCT q) AS levels, round(sum(abs(x::DOUBLE - q::DOUBLE)), 5) AS far FROM q GROUP BY ALL""",
    "unit_importance": """SELECT unit, round(avg(m), 6) AS importance FROM (SELECT vec_id // 30 AS batch, k // 8 AS unit, avg(abs(x)) AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings) GROUP BY ALL) GROUP BY unit""",
    "feature_rows": """WITH x AS (SELECT conv_id, turn, list_transform(list_filter(string_split(coalesce(text, ''), ''), lambda c: c <> ''), lambda c: unicode(c)) AS x FROM conversations)
        SELECT conv_id, turn, len(x) + 3 AS n, coalesce(list_sum(x), 0)::BIGINT + 13 AS ids, coalesce(list_sum(x), 0)::BIGINT + 2 - 200 AS labels, len(x) + 3 AS mask FROM x""",
}
QUERIES: dict = {name: globals()[name] for name in [*SQL, "speaker_scores"]}
