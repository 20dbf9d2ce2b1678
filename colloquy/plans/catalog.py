"""The engine's named queries, as DataFrames, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import intervals, metrics, selection, vectors

GAP_MS, HOP_SIZE_MS, HOP_STEP_MS = 3_600_000, 7_200_000, 3_600_000
FRAME_MS = 60_000


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    second = F.date_part(F.lit("SECOND"), ts)
    return (F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1000 + F.floor(second * 1000).cast("long")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as intervals: value is the length in minutes."""
    e = _t(spark, d, "events")
    start = _ms(F.col("ts"))
    return e.select("event_id", "user_id", "event_type", start.alias("start"), (start + F.floor(F.col("value") * 60000).cast("long")).alias("end"))


_SPANS = "(SELECT event_id, user_id, event_type, epoch_us(ts)//1000 AS s, epoch_us(ts)//1000 + CAST(floor(value*60000) AS BIGINT) AS e FROM events)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as timed segments: 80 ms a letter, 300 ms at least, one after the other."""
    c = _t(spark, d, "conversations")
    long = F.greatest(F.length("text") * 80, F.lit(300)).cast("long")
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("_d", long).withColumn("end", F.sum("_d").over(upto))
    return c.select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text", (F.col("end") - F.col("_d")).alias("start"), "end")


def perturbed(segs: DataFrame) -> DataFrame:
    """A stand-in hypothesis: every ninth word is lost, times shift, every fifth turn changes speaker."""
    words = F.split("text", " ")
    kept = F.array_join(F.filter(words, lambda w, i: i % 9 != 4), " ")
    other = F.when(F.col("pos") % 5 == 3, F.lit("other")).otherwise(F.col("speaker"))
    return segs.select("conv_id", "pos", other.alias("speaker"), kept.alias("text"), (F.col("start") + 40).alias("start"), (F.col("end") + 90).alias("end"))


# ---------------------------------------------------------------- text and tokens
def mixed_token_counts(spark, d):
    return _t(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def role_token_streams(spark, d):
    c = _t(spark, d, "conversations").withColumn("tok", T.tokens(F.col("text")))
    all_ = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tok"))), lambda x: x["tok"]))
    return c.groupBy("conv_id", "role").agg(all_.alias("s")).select("conv_id", "role", F.size("s").cast("long").alias("n_tokens"), F.md5(F.array_join("s", " ").cast("binary")).alias("stream_md5"))


def vocabulary_coverage(spark, d):
    n = mixed_token_counts(spark, d)
    return n.agg(
        F.count("*").alias("n_kinds"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(F.col("n") >= 5, 1).otherwise(0)).cast("long").alias("kept_kinds"),
        F.round(F.sum(F.when(F.col("n") >= 5, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage"),
    )


def fact_sets(spark, d):
    f = T.salient_facts(T.without_markup(F.col("text")))
    return _t(spark, d, "documents").select("doc_id", f.alias("f")).where(F.size("f") > 0).select("doc_id", F.size("f").cast("long").alias("n_facts"), F.array_join("f", "|").alias("facts"))


def speaker_first_appearance(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("first_turn", "role"))
    return c.select("conv_id", "role", "first_turn", F.format_string("S%02d", n).alias("label"))


def roster_first_utterance(spark, d):
    c = selection.top(_t(spark, d, "conversations"), ["conv_id", "role"], [F.col("turn")], 1)
    return selection.top(c, ["conv_id"], [F.col("turn"), F.col("role")], 12).select("conv_id", "role", "turn", F.substring("text", 1, 60).alias("snippet"))


def last_snippets(spark, d):
    return selection.top(_t(spark, d, "conversations"), ["conv_id", "role"], [F.col("turn").desc()], 3).select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"))


def round_robin(spark, d):
    own = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    c = _t(spark, d, "conversations").withColumn("_own", own)
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("_own", "role"))
    return c.select("conv_id", "turn", "role", place.cast("long").alias("place"))


def context_lines(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    line = F.concat_ws(": ", "role", F.substring("text", 1, 20))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list(line).over(w), " / ").alias("context"))


# ---------------------------------------------------------------- selection and mixing
def eval_exact_decontaminate(spark, d):
    key = F.md5(F.trim("text").cast("binary"))
    held = _t(spark, d, "benchmark").select(key.alias("k")).distinct()
    docs = _t(spark, d, "documents").select("doc_id", "lang", key.alias("k"))
    clean = docs.where("k is not null").join(held, "k", "left_anti").unionByName(docs.where("k is null"))
    return clean.groupBy("lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def eval_containment(spark, d):
    return selection.containing(_t(spark, d, "documents"), _t(spark, d, "benchmark"), "doc_id", "text", "text").select(F.col("id").alias("doc_id"))


def hour_budget_mix(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return selection.within_budget(docs, ["lang"], "n_chars", [F.col("h"), F.col("doc_id")], 100_000).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.sum("doc_id").alias("id_sum"))


def train_val_split(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return selection.split_rows(docs, ["lang"], [F.col("h"), F.col("doc_id")], 2).groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


def confidence_filter(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels").where("quality >= 1"), "doc_id").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def reject_reasons(spark, d):
    ladder = [
        ("empty", F.coalesce(F.col("n_chars"), F.lit(0)) == 0),
        ("short", F.col("n_chars") < 200),
        ("table", F.contains("text", F.lit(" | "))),
        ("symbols", F.length(F.regexp_replace("text", "[^#$%&*]", "")) * 20 > F.col("n_chars")),
        ("long", F.col("n_chars") > 20_000),
    ]
    return _t(spark, d, "documents").groupBy(selection.first_reason(ladder).alias("reason")).agg(F.count("*").alias("n"))


def topk_per_bucket(spark, d):
    return selection.top(_t(spark, d, "documents"), ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).select("lang", "source", "doc_id", "n_chars")


def first_seen_distinct(spark, d):
    return _t(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").select("doc_id", "copies")


def upsert_last_wins(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")
    return selection.last_wins(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def resume_todo(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("todo"))


def weighted_slice_means(spark, d):
    x = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    g = metrics.gate(x, ["lang"], "quality", "n_chars", 0.9)
    return g.select(F.when(F.col("overall"), "all").otherwise(F.col("lang")).alias("slice"), F.round("mean", 6).alias("mean"), "n", "passed")


# ---------------------------------------------------------------- intervals
def gap_merge_islands(spark, d):
    i = intervals.islands(spans(spark, d), ["user_id"], "start", "end", GAP_MS)
    return i.groupBy("user_id", "island").agg(F.min("start").alias("first_ms"), F.max("end").alias("last_ms"), F.count("*").alias("n"))


def interval_overlap_vote(spark, d):
    s = spans(spark, d)
    a = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), "start", "end")
    b = s.where("event_type <> 'view'").select("user_id", F.col("event_id").alias("b_id"), "start", "end")
    o = intervals.overlaps(a, b, ["user_id"], 3_600_000).join(s.select(F.col("event_id").alias("b_id"), "event_type"), "b_id")
    by = o.groupBy("a_id", "event_type").agg(F.sum("overlap").alias("overlap_ms"))
    return selection.top(by, ["a_id"], [F.col("overlap_ms").desc(), F.col("event_type")], 1).select("a_id", "event_type", "overlap_ms")


def sustained_start(spark, d):
    r = intervals.sustained_start(spans(spark, d).select("user_id", F.col("start").alias("t")), ["user_id"], "t", 7_200_000, 3, 5000)
    return r.select("user_id", F.col("start").alias("start_ms"))


def hopping_windows(spark, d):
    s = spans(spark, d).select("event_type", F.explode(intervals.hops(F.col("start"), HOP_SIZE_MS, HOP_STEP_MS)).alias("window_ms"))
    return s.groupBy("event_type", "window_ms").agg(F.count("*").alias("n"))


def frame_activity(spark, d):
    """Frames in which a user is active, counted by runs of them."""
    runs = metrics.frame_ranges(spans(spark, d).withColumn("speaker", F.lit("")), "user_id", FRAME_MS)
    return runs.groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("frames"), F.min("start").alias("first_frame"), (F.max("end") - 1).alias("last_frame"))


def carry_forward_label(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    e = _t(spark, d, "events").select("event_id", "user_id", F.coalesce(F.last(said, True).over(w), F.lit("S01")).alias("label"))
    return e.groupBy("user_id", "label").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


def next_start_end(spark, d):
    w = Window.partitionBy("user_id").orderBy("start", "event_id")
    e = spans(spark, d).withColumn("to", F.least(F.coalesce(F.lead("start").over(w), F.col("start") + 600_000), F.col("start") + 600_000))
    return e.groupBy("user_id").agg(F.sum(F.col("to") - F.col("start")).alias("held_ms"), F.count("*").alias("n"))


def corpus_quantiles(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(*(F.round(F.percentile("value", p), 6).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9))))


def sorted_index_stats(spark, d):
    keys = ["event_type", "user_id"]
    w = Window.partitionBy(*keys)
    e = _t(spark, d, "events").select(*keys, "value", (F.row_number().over(w.orderBy("value")) - 1).alias("r"), F.count("*").over(w).alias("n"))
    at = lambda share: F.max(F.when(F.col("r") == F.floor(F.col("n") * share / 10), F.col("value")))
    return e.groupBy(*keys).agg(at(5).alias("median"), at(9).alias("p90"))


# ---------------------------------------------------------------- vectors
def speaker_centroids(spark, d):
    c = vectors.centroids(_t(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 4).alias("x"))


def _nearest(spark, d):
    e = _t(spark, d, "embeddings")
    return vectors.nearest(e, "embedding", vectors.centroids(e, "label", "embedding"), "label")


def nearest_centroid(spark, d):
    return _nearest(spark, d).groupBy("label", "nearest").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("similarity"))


def nearest_speaker(spark, d):
    """The nearest of centroids that go by name; names order otherwise than numbers."""
    e = _t(spark, d, "embeddings").withColumn("who", F.concat(F.lit("S"), (F.col("label") * 7).cast("string")))
    near = vectors.nearest(e, "embedding", vectors.centroids(e, "who", "embedding"), "who")
    return near.groupBy("who", "nearest").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 5).alias("similarity"))


def majority_purity(spark, d):
    n = _nearest(spark, d).groupBy("nearest", "label").agg(F.count("*").alias("n"))
    best = selection.top(n, ["nearest"], [F.col("n").desc(), F.col("label")], 1).select("nearest", F.col("label").alias("voted"), F.col("n").alias("hits"))
    total = n.groupBy("nearest").agg(F.sum("n").alias("total"))
    return best.join(total, "nearest").select("nearest", "voted", "hits", "total", F.round(F.col("hits") / F.col("total"), 6).alias("purity"))


# ---------------------------------------------------------------- star schema
def pricing_summary(spark, d):
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return _t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(disc), 2).alias("sum_disc"), F.count("*").alias("n"))


def nation_revenue(spark, d):
    o, c, n, r = (_t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("n"))


# ---------------------------------------------------------------- metrics without an SQL twin
def _one_text(segs: DataFrame) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "pos", "text"))), lambda x: x["text"]), " ")
    return segs.groupBy("conv_id").agg(text.alias("text"))


def cpwer(spark, d):
    s = segments(spark, d)
    return metrics.cpwer(s, perturbed(s), "conv_id")


def speaker_errors(spark, d):
    s = segments(spark, d)
    return metrics.speaker_errors(s, perturbed(s), "conv_id")


def timestamp_mae(spark, d):
    s = segments(spark, d)
    return metrics.timestamp_error(s, perturbed(s), "conv_id")


def link_speakers(spark, d):
    e = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).cast("bigint").alias("rec"), "vec_id", F.lit(5.0).alias("sec"), "embedding")
    return vectors.link_speakers(e, "rec", "vec_id", "sec", "embedding")


def target_lines(spark, d):
    s = segments(spark, d).withColumns({"start": F.col("start") / 1000, "end": F.col("end") / 1000})
    g = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "speaker", "text"))).alias("s"))
    return g.select("conv_id", T.target_text(F.col("s")).alias("target"))


_TOK = T.TOKEN.replace("'", "''")
_NEAR = """(WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM n),
 l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u),
 s AS (SELECT label, k, sum(x) AS x FROM l GROUP BY ALL),
 c0 AS (SELECT label, list(x ORDER BY k) AS c FROM s GROUP BY label),
 c AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM c0),
 p AS (SELECT u.vec_id, u.label, c.label AS nearest, list_inner_product(u.v, c.c) AS similarity FROM u, c)
 SELECT vec_id, label, nearest, similarity FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, nearest) = 1)"""

SQL = {
    "mixed_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_TOK}')) AS token FROM documents) GROUP BY token",
    "role_token_streams": f"""SELECT conv_id, role, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS n_tokens, md5(coalesce(string_agg(j, ' ' ORDER BY turn) FILTER (len(t) > 0), '')) AS stream_md5
        FROM (SELECT conv_id, role, turn, t, array_to_string(t, ' ') AS j FROM (SELECT conv_id, role, turn, regexp_extract_all(lower(text), '{_TOK}') AS t FROM conversations)) GROUP BY conv_id, role""",
    "vocabulary_coverage": f"""WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_TOK}')) AS token FROM documents) GROUP BY token)
        SELECT count(*) AS n_kinds, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN n >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS kept_kinds, round(sum(CASE WHEN n >= 5 THEN n ELSE 0 END) / sum(n), 6) AS coverage FROM c""",
    "fact_sets": rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{T.TIME_MARK}', ' ', 'g'), '\[S\d+\]|\bS\d+\s*[:：]', ' ', 'g') AS t FROM documents),
        f AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_concat(regexp_extract_all(t, '{T.PERCENT}'), regexp_extract_all(t, '{T.AMOUNT}'), regexp_extract_all(t, '{T.DATE}')), lambda x: replace(x, ' ', '')))) AS f FROM m)
        SELECT doc_id, CAST(len(f) AS BIGINT) AS n_facts, array_to_string(f, '|') AS facts FROM f WHERE len(f) > 0""",
    "speaker_first_appearance": """SELECT conv_id, role, first_turn, printf('S%02d', row_number() OVER (PARTITION BY conv_id ORDER BY first_turn, role)) AS label
        FROM (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY conv_id, role)""",
    "roster_first_utterance": """SELECT conv_id, role, turn, substr(text, 1, 60) AS snippet FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1)
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) <= 12""",
    "last_snippets": "SELECT conv_id, role, turn, length(text) AS n_chars FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) <= 3",
    "round_robin": """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY own, role) AS place
        FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS own FROM conversations)""",
    "context_lines": """SELECT conv_id, turn, coalesce(string_agg(role || ': ' || substr(text, 1, 20), ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations""",
    "eval_exact_decontaminate": "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents WHERE md5(trim(text)) NOT IN (SELECT md5(trim(text)) FROM benchmark) GROUP BY lang",
    "eval_containment": "SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON position(b.text IN d.text) > 0",
    "hour_budget_mix": """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 100000 GROUP BY lang""",
    "train_val_split": """SELECT lang, split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM (SELECT lang, doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR))) <= greatest(round_even(count(*) OVER (PARTITION BY lang) * 2 / 100, 0), 1) THEN 'val' ELSE 'train' END AS split FROM documents) GROUP BY lang, split""",
    "confidence_filter": "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) WHERE quality >= 1 GROUP BY lang, source",
    "reject_reasons": """SELECT CASE WHEN coalesce(n_chars, 0) = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN contains(text, ' | ') THEN 'table'
        WHEN length(regexp_replace(text, '[^#$%&*]', '', 'g')) * 20 > n_chars THEN 'symbols' WHEN n_chars > 20000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY reason""",
    "topk_per_bucket": "SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) <= 3",
    "first_seen_distinct": "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1",
    "upsert_last_wins": "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "resume_todo": "SELECT lang, count(*) AS todo FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang",
    "weighted_slice_means": """WITH x AS (SELECT lang, quality, CASE WHEN n_chars > 0 THEN n_chars ELSE 1 END AS w FROM documents JOIN labels USING (doc_id))
        SELECT coalesce(lang, 'all') AS slice, round(sum(quality * w) / sum(w), 6) AS mean, count(*) AS n, sum(quality * w) / sum(w) <= 0.9 AS passed FROM x GROUP BY ROLLUP (lang)""",
    "gap_merge_islands": f"""WITH a AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {_SPANS}),
        b AS (SELECT *, sum(CASE WHEN m IS NULL OR s - m >= {GAP_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e) AS island FROM a)
        SELECT user_id, CAST(island AS BIGINT) AS island, min(s) AS first_ms, max(e) AS last_ms, count(*) AS n FROM b GROUP BY user_id, island""",
    "interval_overlap_vote": f"""WITH o AS (SELECT a.event_id AS a_id, b.event_type, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS overlap_ms FROM {_SPANS} a JOIN {_SPANS} b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e
        WHERE a.event_type = 'view' AND b.event_type <> 'view' GROUP BY ALL) SELECT a_id, event_type, overlap_ms FROM o QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY overlap_ms DESC, event_type) = 1""",
    "sustained_start": f"""WITH n AS (SELECT user_id, s, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 7199999 FOLLOWING) AS n FROM {_SPANS})
        SELECT user_id, greatest(coalesce(min(CASE WHEN n >= 3 THEN s END), min(s)) - 5000, 0) AS start_ms FROM n GROUP BY user_id""",
    "hopping_windows": f"""SELECT event_type, k * {HOP_STEP_MS} AS window_ms, count(*) AS n FROM (SELECT event_type, unnest(range(greatest((s - {HOP_SIZE_MS}) // {HOP_STEP_MS} + 1, 0), s // {HOP_STEP_MS} + 1)) AS k FROM {_SPANS}) GROUP BY event_type, k""",
    "frame_activity": f"""WITH f AS (SELECT DISTINCT user_id, unnest(range(CAST(ceil((s - {FRAME_MS // 2}) / {FRAME_MS}) AS BIGINT), CAST(ceil((e - {FRAME_MS // 2}) / {FRAME_MS}) AS BIGINT))) AS f FROM {_SPANS})
        SELECT user_id, count(*) AS frames, min(f) AS first_frame, max(f) AS last_frame FROM f GROUP BY user_id""",
    "carry_forward_label": """SELECT user_id, label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'S01') AS label FROM events) GROUP BY user_id, label""",
    "next_start_end": f"""SELECT user_id, CAST(sum(least(coalesce(nx, s + 600000), s + 600000) - s) AS BIGINT) AS held_ms, count(*) AS n FROM (SELECT user_id, s, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nx FROM {_SPANS}) GROUP BY user_id""",
    "corpus_quantiles": "SELECT event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type",
    "sorted_index_stats": "SELECT event_type, user_id, v[len(v) // 2 + 1] AS median, v[len(v) * 9 // 10 + 1] AS p90 FROM (SELECT event_type, user_id, list(value ORDER BY value) AS v FROM events GROUP BY event_type, user_id)",
    "speaker_centroids": """WITH n AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM n),
        l AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM u), s AS (SELECT label, k, sum(x) AS x FROM l GROUP BY ALL)
        SELECT label, CAST(k - 1 AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS x FROM s""",
    "nearest_centroid": f"SELECT label, nearest, count(*) AS n, round(avg(similarity), 5) AS similarity FROM {_NEAR} GROUP BY label, nearest",
    "nearest_speaker": f"SELECT 'S' || label * 7 AS who, 'S' || nearest * 7 AS nearest, count(*) AS n, round(avg(similarity), 5) AS similarity FROM {_NEAR} GROUP BY ALL",
    "majority_purity": f"""WITH c AS (SELECT nearest, label, count(*) AS n FROM {_NEAR} GROUP BY ALL), t AS (SELECT nearest, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY nearest)
        SELECT c.nearest, c.label AS voted, c.n AS hits, t.total, round(c.n / t.total, 6) AS purity FROM c JOIN t USING (nearest) QUALIFY row_number() OVER (PARTITION BY c.nearest ORDER BY c.n DESC, c.label) = 1""",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "nation_revenue": "SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
}

SQL["target_lines"] = """WITH c AS (SELECT *, greatest(length("text") * 80, 300)::BIGINT AS d FROM conversations),
 s AS (SELECT *, sum(d) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM c)
 SELECT conv_id, string_agg(printf('[%.2f][S%02d]%s[%.2f]', (upto - d)::DOUBLE / 1000,
  CASE WHEN regexp_full_match(role, '[0-9]+') THEN try_cast(role AS INT) + 1 ELSE 1 END, "text", upto::DOUBLE / 1000), '' ORDER BY turn) AS target
 FROM s GROUP BY conv_id"""
ROWS_ONLY = ["cpwer", "speaker_errors", "timestamp_mae", "link_speakers"]
QUERIES = {name: globals()[name] for name in [*SQL, *ROWS_ONLY]}
