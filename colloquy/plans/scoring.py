"""Named queries of written forms, scorers, exports and finished recordings, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy.functions import writing as W
from colloquy.operators import consolidation, scoring
from colloquy.plans.catalog import _t, perturbed, segments
from colloquy.plans.records import RECORDING


def spoken_numbers(spark, d):
    """Customer keys said in numerals and written again; numerals of one character stay."""
    c = _t(spark, d, "customer").select("c_custkey", W.spelled(F.col("c_custkey") % 10_000).alias("said"))
    return c.select("c_custkey", W.numbers_written(F.concat(F.lit("共"), "said", F.lit("件"))).alias("written"))


def spoken_shares(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.lit("漲了百分之"), W.spelled(F.col("p_size") + 10), F.lit("點"), W.spelled(F.col("p_partkey") % 10)).alias("said"))
    return p.select("p_partkey", W.numbers_written(F.col("said")).alias("written"))


def scorer_token_counts(spark, d):
    return _t(spark, d, "documents").select(F.explode(W.scorer_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def _opening():
    kind = F.element_at(F.array(F.lit("產品"), F.lit("站立"), F.lit("客戶成功")), (F.col("c_custkey") % 3 + 1).cast("int"))
    cue = F.when(F.col("c_custkey") % 2 == 0, "議題是").otherwise("主要要 align ")
    return F.concat(F.lit("大家好，今天的"), kind, F.lit("會議開始，"), cue, F.col("c_mktsegment"), F.lit("，先說進度。")).alias("said")


def meeting_titles(spark, d):
    return _t(spark, d, "customer").select("c_custkey", _opening()).select("c_custkey", W.title(F.col("said")).alias("title"))


def title_hit_rates(spark, d):
    """Shares of titles that name the kind, name the topic, and are no copy of the transcript."""
    t = _t(spark, d, "customer").select("c_mktsegment", _opening()).select("c_mktsegment", W.title(F.col("said")).alias("t"))
    share = lambda ok: F.round(F.avg(F.when(ok, 1.0).otherwise(0.0)), 6)
    return t.groupBy("c_mktsegment").agg(
        share(F.contains("t", F.lit("站立"))).alias("kind_rate"), share(F.contains("t", "c_mktsegment")).alias("topic_rate"),
        share((F.length("t") < 60) & ~F.contains("t", F.lit("["))).alias("clean_rate"),
    )


def stripped_transcripts(spark, d):
    mark = lambda c: F.format_string("[%.2f]", F.col(c) / 1000)
    s = segments(spark, d).select("conv_id", "pos", F.concat(mark("start"), F.lit("[S01]"), "text", mark("end")).alias("said"))
    return s.select("conv_id", "pos", W.marked_segments(F.col("said")).alias("n"), F.md5(W.without_marks(F.col("said")).cast("binary")).alias("plain_md5"))


def example_exports(spark, d):
    """A conversation as one JSON document."""
    turn = F.struct("turn", "role", F.length("text").alias("chars"))
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    doc = F.to_json(F.struct("conv_id", F.size("turns").alias("n"), "turns"))
    return c.select("conv_id", F.md5(doc.cast("binary")).alias("json_md5"))


def turn_agreement(spark, d):
    """Neighbouring turns of a conversation by matching blocks of characters."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return c.select("conv_id", "turn", F.round(W.agreement(F.col("before"), F.col("text")), 6).alias("agreement"), F.round(W.likeness(F.col("before"), F.col("text")), 6).alias("likeness"))


def crc_shards(spark, d):
    p = _t(spark, d, "part").select(W.shard_of(F.col("p_name"), 16).alias("shard"), "p_partkey")
    return p.groupBy("shard").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("key_sum"))


def _words(segs):
    w = segs.select("conv_id", "pos", "start", "speaker", F.posexplode(W.scorer_tokens(F.col("text"))).alias("k", "token"))
    return w.select("conv_id", "start", (F.col("pos").cast("long") * 1_000_000 + F.col("k")).alias("pos"), "speaker", "token")


def four_axis_scores(spark, d):
    s = segments(spark, d)
    return scoring.four_axes(_words(s), _words(perturbed(s)), "conv_id")


def _store(spark, d):
    """Vectors of made-up recordings, a second each, nine labels dealt in turn."""
    e = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / RECORDING).cast("bigint").alias("rec"), "vec_id", F.col("embedding").alias("vector"))
    at = (F.col("vec_id") % RECORDING).cast("double")
    named = e.select("rec", "vec_id", "vector", at.alias("start"), (at + 1).alias("end"))
    return named.withColumn("speaker", F.concat(F.lit("SPEAKER_"), (F.col("vec_id") * 7 % 9).cast("string")))


def consolidated_speakers(spark, d):
    s = _store(spark, d)
    mapping = consolidation.merge_map(consolidation.speaker_means(s, "rec", "speaker", "vector"), "rec", "speaker")
    return consolidation.relabelled(s.select("rec", "vec_id", "speaker"), mapping, "rec", "speaker")


def reclustered_speakers(spark, d):
    s = _store(spark, d)
    return consolidation.reclustered(s.drop("vector"), s.drop("speaker"), "rec", "speaker", "vec_id").select("rec", "vec_id", "speaker")


_D = "'零一二三四五六七八九'"
SQL = {
    "spoken_numbers": f"SELECT c_custkey, '共' || CASE WHEN c_custkey % 10000 < 10 THEN substr({_D}, CAST(c_custkey % 10000 + 1 AS INT), 1) ELSE CAST(c_custkey % 10000 AS VARCHAR) END || '件' AS written FROM customer",
    "spoken_shares": "SELECT p_partkey, '漲了' || (p_size + 10) || '.' || (p_partkey % 10) || '%' AS written FROM part",
    "scorer_token_counts": r"""WITH c AS (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ')) AS c FROM documents),
        t AS (SELECT unnest(CASE WHEN regexp_matches(c, '[一-鿿]') THEN string_split(c, '') ELSE [c] END) AS token FROM c) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token""",
    "meeting_titles": "SELECT c_custkey, ['產品', '站立', '客戶成功'][CAST(c_custkey % 3 + 1 AS INT)] || '會議：' || c_mktsegment AS title FROM customer",
    "title_hit_rates": "SELECT c_mktsegment, round(avg(CASE WHEN c_custkey % 3 = 1 THEN 1.0 ELSE 0.0 END), 6) AS kind_rate, 1.0::DOUBLE AS topic_rate, 1.0::DOUBLE AS clean_rate FROM customer GROUP BY c_mktsegment",
    "stripped_transcripts": r"SELECT conv_id, turn AS pos, CAST(1 AS BIGINT) AS n, md5(regexp_replace(text, '[，。、！？；：,.!?;:\s]', '', 'g')) AS plain_md5 FROM conversations",
    "example_exports": """WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'chars': length(text)} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)
        SELECT conv_id, md5(CAST(to_json({'conv_id': conv_id, 'n': len(turns), 'turns': turns}) AS VARCHAR)) AS json_md5 FROM c""",
}
ROWS_ONLY = ["turn_agreement", "crc_shards", "four_axis_scores", "consolidated_speakers", "reclustered_speakers"]
QUERIES: dict = {name: globals()[name] for name in [*SQL, *ROWS_ONLY]}
