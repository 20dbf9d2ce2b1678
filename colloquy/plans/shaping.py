"""Named queries of record filters, segment shaping, gates and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.edits import edit_distance
from colloquy.operators import intervals, metrics, selection, shaping
from colloquy.plans.catalog import _SPANS, _TOK, _one_text, _t, perturbed, segments, spans

# Full-width forms of the ASCII letters and digits, in order.
_PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_WIDE = "".join(chr(ord(c) + 0xFEE0) for c in _PLAIN)

#: Conversations as the segments of ``catalog.segments``, in SQL.
_SEGS = """(SELECT conv_id, turn AS pos, role AS speaker, text, CAST(e - d AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM
  (SELECT *, sum(d) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM (SELECT *, greatest(length(text) * 80, 300) AS d FROM conversations)))"""
_LOST = "array_to_string(list_filter(string_split(text, ' '), lambda w, i: (i - 1) % 9 <> 4), ' ')"


# ---------------------------------------------------------------- texts
def fullwidth_token_counts(spark, d):
    wide = F.translate("text", _PLAIN, _WIDE)
    return _t(spark, d, "documents").select(F.explode(T.tokens(wide)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def fidelity_reports(spark, d):
    """A conversation's last turn as the summary of all of it."""
    c = _t(spark, d, "conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("said"), F.max_by("text", "turn").alias("summary"))
    return whole.select("conv_id", T.fidelity(F.col("said"), F.col("summary")).alias("f")).select("conv_id", "f.*")


def fact_coverage(spark, d):
    """Salient facts of a document that its first 200 characters have."""
    facts, head = T.salient_facts(F.col("text")), T.salient_facts(F.substring("text", 1, 200))
    x = _t(spark, d, "documents").select("doc_id", facts.alias("f"), head.alias("h")).where(F.size("f") > 0)
    held = F.array_intersect("f", "h")
    return x.select("doc_id", F.size("f").cast("long").alias("n"), F.size(held).cast("long").alias("covered"), F.array_join(F.array_sort(F.array_except("f", "h")), "|").alias("missed"))


def cleaned_texts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(T.cleaned(F.col("text")).cast("binary")).alias("cleaned_md5"))


def layer_families(spark, d):
    p = _t(spark, d, "part")
    return p.groupBy(T.family(F.col("p_brand")).alias("family")).agg(F.count("*").alias("n"), F.min(T.id_number(F.col("p_brand"))).alias("lowest"), F.max(T.id_number(F.col("p_brand"))).alias("highest"))


def loop_flags(spark, d):
    c = F.split(F.regexp_replace("text", r"\s+", ""), "")
    return _t(spark, d, "conversations").select("conv_id", "turn", T.loops(c).alias("loop"))


def turn_likeness(spark, d):
    """Jaccard likeness of the words of neighbouring turns; none where either has no word."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, d, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    c = c.withColumn("before", F.lag("t").over(w)).where("before is not null")
    return c.select("conv_id", "turn", F.round(T.jaccard(F.col("before"), F.col("t")), 6).alias("likeness"))


def joined_turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return c.select("conv_id", "turn", F.length(T.joined(F.col("before"), F.col("text"))).cast("long").alias("n_chars"))


def padded_lengths(spark, d):
    """Lengths of a conversation's last six turns, filled with -1."""
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("n"))
    return c.select("conv_id", F.array_join(T.padded(F.col("n"), 6, -1), ",").alias("lengths"))


def position_weights(spark, d):
    """Weights of line positions: quantities are ids, 50 is special, 1 is masked."""
    label = F.when(F.col("l_quantity") == 1, -100).otherwise(F.col("l_quantity").cast("int"))
    l = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", label.alias("x")))), lambda s: s["x"]).alias("x"))  # noqa: E741
    return l.select("l_orderkey", F.array_join(T.token_weights(F.col("x"), F.array(F.lit(50))), ",").alias("weights"))


# ---------------------------------------------------------------- filters
def metadata_confidence(spark, d):
    return shaping.confident(_t(spark, d, "events"), "props", "k", 50.0).groupBy("event_type").agg(F.count("*").alias("n"))


def column_or_metadata(spark, d):
    return shaping.matching(_t(spark, d, "events"), {"event_type": "view", "k": "7"}, "props").select("event_id", "user_id")


def two_pass_agreement(spark, d):
    """Conversations whose two transcripts differ in at most 12 of 100 tokens, joined by key."""
    s = segments(spark, d)
    a, b = (_one_text(x).select("conv_id", T.tokens(F.col("text")).alias(n)) for x, n in ((s, "a"), (perturbed(s), "b")))
    both = a.join(b, "conv_id").select("conv_id", edit_distance(F.col("a"), F.col("b")).cast("long").alias("edits"), F.size("a").cast("long").alias("n_a"), F.size("b").alias("n_b"))
    rate = F.when(F.col("n_a") == 0, F.when(F.col("n_b") == 0, 0.0).otherwise(1.0)).otherwise(F.col("edits") / F.col("n_a"))
    return both.select("conv_id", "edits", "n_a", (rate <= 0.12).alias("agree"))


def mer_per_conversation(spark, d):
    s = segments(spark, d)
    m = metrics.mixed_error_rate(_one_text(s), _one_text(perturbed(s)), "conv_id")
    return m.select("conv_id", F.col("edits").cast("long").alias("edits"), F.col("n_ref").cast("long").alias("n_ref"), F.col("n_hyp").cast("long").alias("n_hyp"), "mer", (F.col("mer") <= 0.12).alias("passed"))


def selected_records(spark, d):
    """The first 40 records of two languages, in order, that have a source and a text of some length."""
    x = _t(spark, d, "documents").where(F.col("lang").isin("de", "fr") & F.col("source").isNotNull() & F.col("n_chars").between(300, 5000))
    return x.orderBy("doc_id").limit(40).select("doc_id", "lang", "n_chars")


def fused_segments(spark, d):
    """Views of 5 to 90 minutes that one other kind of event dominates and others cover."""
    s = spans(spark, d)
    a = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), "start", "end")
    b = s.where("event_type <> 'view'").select("user_id", F.col("event_id").alias("b_id"), "start", "end")
    o = intervals.overlaps(a, b, ["user_id"], 3_600_000).join(s.select(F.col("event_id").alias("b_id"), "event_type"), "b_id")
    by = o.groupBy("a_id", "event_type").agg(F.sum("overlap").alias("ms"), (F.first("e1") - F.first("s1")).alias("long"))
    all_ = Window.partitionBy("a_id")
    best = selection.top(by.withColumn("total", F.sum("ms").over(all_)), ["a_id"], [F.col("ms").desc(), F.col("event_type")], 1)
    ok = F.col("long").between(300_000, 5_400_000) & (F.col("ms") >= F.col("total") * 0.5) & (F.col("total") >= F.col("long") * 0.3)
    return best.where(ok).select("a_id", "event_type", "ms", "total")


def usable_conversations(spark, d):
    c = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("speakers"), F.sum(F.length("text")).alias("chars"))
    held = _t(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("conv_id"))
    return c.where("turns >= 3 and speakers >= 2 and chars >= 200").join(held, "conv_id", "left_anti")


def excluded_names(spark, d):
    banned = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    c = _t(spark, d, "customer").where(~F.regexp_like("c_name", F.lit("(00|11)[0-9]$"))).join(banned, "c_nationkey", "left_anti")
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"))


def without_noise(spark, d):
    """Shards put together, without the rows that hold a mark."""
    docs, turns = _t(spark, d, "documents").select("text", F.lit("documents").alias("shard")), _t(spark, d, "conversations").select("text", F.lit("conversations").alias("shard"))
    return docs.unionByName(turns).where(~(F.contains("text", F.lit("@")) | F.contains("text", F.lit("#")))).groupBy("shard").agg(F.count("*").alias("n"))


def usable_records(spark, d):
    c = _t(spark, d, "conversations").groupBy("role", "conv_id").agg(F.some(~F.startswith("text", F.lit("T"))).alias("usable"))
    return c.groupBy("role").agg(F.sum(F.when(F.col("usable"), 1).otherwise(0)).alias("n"))


def sampled_segments(spark, d):
    s = segments(spark, d).where((F.col("end") - F.col("start")).between(4000, 20_000) & (F.length("text") >= 15))
    order = F.md5(F.concat(F.lit("seed-7:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("pos").cast("string")).cast("binary"))
    return s.withColumn("o", order).orderBy("o", "conv_id", "pos").limit(25).select("conv_id", "pos", "speaker")


def shortest_demo(spark, d):
    """Of each kind the shortest clock time between two bounds."""
    e = _t(spark, d, "events").withColumn("sec", shaping.hms_seconds(F.date_format("ts", "H:m:s")))
    return selection.top(e.where(F.col("sec").between(3600, 40_000)), ["event_type"], [F.col("sec"), F.col("event_id")], 1).select("event_type", "event_id", F.col("sec").cast("long").alias("sec"))


def window_core(spark, d):
    """Events in the windows in whose inner part, half the overlap off either side, their middle lies."""
    size, step, edge = 7_200_000, 3_600_000, 1_800_000
    s = spans(spark, d).withColumn("mid", F.floor((F.col("start") + F.col("end")) / 2))
    w = s.select("event_id", "mid", F.explode(intervals.hops(F.col("mid"), size, step)).alias("w"))
    return w.where((F.col("mid") >= F.col("w") + edge) & (F.col("mid") < F.col("w") + size - edge)).groupBy("w").agg(F.count("*").alias("n"))


def valid_timelines(spark, d):
    s = segments(spark, d).withColumn("start", F.when(F.col("pos") % 11 == 7, F.col("start") - 5000).otherwise(F.col("start")))
    return shaping.valid_timelines(s, "conv_id", "pos", "start", "end", F.lit(600_000))


# ---------------------------------------------------------------- joins, windows and segments
def overlap_or_own_label(spark, d):
    """Views take the kind they overlap most; one that overlaps none keeps its own."""
    s = spans(spark, d)
    a = s.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a_id"), "start", "end")
    b = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("b_id"), "start", "end")
    o = intervals.overlaps(a, b, ["user_id"], 3_600_000)
    best = selection.top(o, ["a_id"], [F.col("overlap").desc(), F.col("b_id")], 1).select("a_id", "b_id")
    return a.select("a_id").join(best, "a_id", "left").select("a_id", F.coalesce("b_id", "a_id").alias("label_id"))


def shifted_and_clipped(spark, d):
    s = segments(spark, d).withColumns({"start": F.col("start") - 20_000, "end": F.col("end") - 20_000}).where("end > 0 and start < 60000")
    return s.select("conv_id", "pos", F.greatest("start", F.lit(0)).alias("from_ms"), F.least("end", F.lit(60_000)).alias("to_ms"))


def merged_regions(spark, d):
    r = shaping.merged_regions(spans(spark, d), ["user_id"], "start", "end", "event_type", 3_600_000)
    return r.select("user_id", "region", "event_type", F.col("start").alias("first_ms"), F.col("end").alias("last_ms"), "n")


def first_rule_wins(spark, d):
    rules = [("STEEL", "metal"), ("BRASS", "metal"), ("SMALL", "small"), ("PROMO", "promo")]
    return _t(spark, d, "part").groupBy(shaping.first_rule(F.upper("p_type"), rules, F.lit("other")).alias("kind")).agg(F.count("*").alias("n"))


def run_parity(spark, d):
    """Two token streams place by place, to the shorter one's length."""
    s = segments(spark, d)
    a, b = (_one_text(x).select("conv_id", T.tokens(F.col("text")).alias(n)) for x, n in ((s, "a"), (perturbed(s), "b")))
    n = F.least(F.size("a"), F.size("b"))
    same = F.size(F.filter(F.zip_with(F.slice("a", 1, n), F.slice("b", 1, n), lambda x, y: x == y), lambda x: x))
    return a.join(b, "conv_id").select("conv_id", n.cast("long").alias("n"), same.cast("long").alias("same"))


def recordings_on_disk(spark, d):
    """Catalog rows with a payload: semi join for what exists, inner join for its numbers."""
    docs, pages = _t(spark, d, "documents").select("doc_id", "lang"), _t(spark, d, "labels").select("doc_id", "quality")
    have = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docs.join(have, "doc_id", "left_semi").join(pages, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("good"))


def roster_prompt(spark, d):
    """Speakers by last word, latest first, each with the snippet."""
    c = _t(spark, d, "conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("last"), F.max_by(F.substring("text", 1, 20), "turn").alias("snippet"))
    top = selection.top(c, ["conv_id"], [F.col("last").desc(), F.col("role")], 12)
    line = F.struct((-F.col("last")).alias("o"), "role", F.concat_ws(": ", "role", "snippet").alias("line"))
    return top.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("roster"))


def mode_smoothing(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 7 % 5).alias("label"))
    return shaping.smoothed(e, ["user_id"], "event_id", "label", 2).groupBy("user_id", "label").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


def text_smoothing(spark, d):
    """Labels that are texts, smoothed by one neighbour either side."""
    return shaping.smoothed(_t(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", 1)


def pooled_clips(spark, d):
    p = shaping.budget_parts(spans(spark, d).withColumn("ms", F.col("end") - F.col("start")), ["user_id"], [F.col("start"), F.col("event_id")], "ms", 50_000_000)
    return p.where("used > 0").groupBy("user_id").agg(F.count("*").alias("clips"), F.sum("used").alias("used_ms"))


def merged_notes(spark, d):
    """The first note of each opening in a conversation, three a speaker at most."""
    c = _t(spark, d, "conversations").withColumn("sign", F.lower(F.substring("text", 1, 12)))
    first = selection.top(c, ["conv_id", "sign"], [F.col("turn")], 1)
    return selection.top(first, ["conv_id", "role"], [F.col("turn")], 3).select("conv_id", "role", "turn")


def position_shards(spark, d):
    x = selection.running(_t(spark, d, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")])
    x = x.select("lang", "doc_id", ((F.col("_place") - 1) % 4).alias("shard"))
    return x.groupBy("lang", "shard").agg(F.count("*").alias("n"), F.sum("doc_id").alias("id_sum"))


# ---------------------------------------------------------------- aggregates, rankings and gates
def vocabulary_report(spark, d):
    counts = _t(spark, d, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    forced = _t(spark, d, "nation").select(F.lower("n_name").alias("token"))
    v = shaping.kept_vocabulary(counts, "token", "n", 3, forced)
    return v.groupBy("kept").agg(F.count("*").alias("kinds"), F.sum("n").alias("tokens"))


def dropped_tokens(spark, d):
    counts = _t(spark, d, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.where("n < 3").orderBy(F.col("n").desc(), "token").limit(100)


def window_health(spark, d):
    c = _t(spark, d, "conversations")
    by_text = c.groupBy("conv_id", "text").agg(F.count("*").alias("k")).groupBy("conv_id").agg(F.max("k").alias("max_repeat"), F.count("*").alias("kinds"))
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("role").alias("speakers"), F.percentile(F.length("text"), 0.5).alias("median_chars"), F.sum(F.regexp_count("text", F.lit("\\."))).cast("long").alias("marks"))
    return n.join(by_text, "conv_id").select("conv_id", "n", "speakers", "median_chars", "marks", "max_repeat", F.round(1 - F.col("kinds") / F.col("n"), 6).alias("repeated"))


def speaker_histogram(spark, d):
    return _t(spark, d, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("speakers")).groupBy("speakers").agg(F.count("*").alias("n"))


def uneven_cells(spark, d):
    n = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = n.groupBy("user_id").agg(F.max("n").alias("most"), F.min("n").alias("fewest"))
    return s.where(F.col("most") - F.col("fewest") > F.greatest(F.lit(2.0), F.col("most") * 0.25))


def sweep_report(spark, d):
    """Prices by brand with a share of the mean, best first."""
    p = _t(spark, d, "part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("total"), F.avg("p_size").alias("size"), F.count("*").alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col("size"), F.col("p_brand"))
    return p.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 12").select("p_brand", F.round("total", 2).alias("total"), F.round("size", 6).alias("size"), "n", "place")


def loss_means(spark, d):
    x = _t(spark, d, "lineitem")
    return x.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.greatest(F.sum("l_discount"), F.lit(1e-8)), 4).alias("mean"))


def top_indices(spark, d):
    """Of each label the three largest vectors' first values, given in id order."""
    e = _t(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).alias("x"))
    return selection.top(e, ["label"], [F.col("x").desc(), F.col("vec_id")], 3).groupBy("label").agg(F.array_join(F.array_sort(F.collect_list("vec_id")), ",").alias("ids"))


def selected_heads(spark, d):
    """The two kinds with most events, and within each the three users with most."""
    n = _t(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    groups = n.groupBy("event_type").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "event_type").limit(2)
    return selection.top(n.join(groups, "event_type"), ["event_type"], [F.col("n").desc(), F.col("user_id")], 3).select("event_type", "user_id", "n")


def best_thresholds(spark, d):
    """For each kind the threshold, of a grid, with most events above less those below."""
    grid = spark.range(0, 100, 10).select(F.col("id").alias("t"))
    # a grid of ten rows, whatever the table
    e = _t(spark, d, "events").select("event_type", "value").join(F.broadcast(grid))
    score = e.groupBy("event_type", "t").agg(F.sum(F.when(F.col("value") >= F.col("t"), F.col("t")).otherwise(-1)).alias("score"))
    return selection.top(score, ["event_type"], [F.col("score").desc(), F.col("t")], 1)


def threshold_gates(spark, d):
    """Gates of two metrics over all documents and single languages; a slice nobody has is left out."""
    m = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("w"), "quality", "toxic")
    limits = {"quality": 0.5, "toxic": 0.2, "de_quality": 0.9, "fr_toxic": 0.01, "xx_toxic": 0.5, "speed": 1.0}
    g = metrics.run_gates(m, limits, "w", "lang")
    return g.select("gate", F.round("value", 6).alias("value"), "limit", "n", "passed")


def release_gates(spark, d):
    """All four error rates of every conversation against their limits."""
    s = segments(spark, d)
    m = metrics.record_metrics(s, perturbed(s), "conv_id").join(s.groupBy("conv_id").agg(F.max("end").cast("double").alias("w")), "conv_id")
    m = m.withColumn("slice", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")).drop("conv_id")
    return metrics.run_gates(m, {"mer": 0.12, "cpwer": 0.16, "der": 0.12, "timestamp_mae": 0.3, "even_mer": 0.12}, "w", "slice")


def stage_gates(spark, d):
    """A table of limits met by a table of figures, each from its own side."""
    limits = spark.createDataFrame([("n", 10.0, True), ("mean", 60.0, False), ("largest", 400.0, False)], "figure string, bound double, at_least boolean")
    e = _t(spark, d, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("largest"))
    long = e.select("event_type", F.explode(F.array(*(F.struct(F.lit(x).alias("figure"), F.col(x).alias("v")) for x in ("n", "mean", "largest")))).alias("x")).select("event_type", "x.*")
    ok = F.when(F.col("at_least"), F.col("v") >= F.col("bound")).otherwise(F.col("v") <= F.col("bound"))
    return long.join(F.broadcast(limits), "figure").select("event_type", "figure", ok.alias("passed"))


_TWO = f"""(WITH s AS (SELECT * FROM {_SEGS}), a AS (SELECT conv_id, regexp_extract_all(lower(string_agg(text, ' ' ORDER BY s, e, pos)), '{_TOK}') AS a FROM s GROUP BY conv_id),
  b AS (SELECT conv_id, regexp_extract_all(lower(string_agg({_LOST}, ' ' ORDER BY s, e, pos)), '{_TOK}') AS b FROM s GROUP BY conv_id) SELECT conv_id, a, b FROM a JOIN b USING (conv_id))"""
_FACTS = lambda x: f"list_sort(list_distinct(list_transform(list_concat(regexp_extract_all({x}, '{T.PERCENT}'), regexp_extract_all({x}, '{T.AMOUNT}'), regexp_extract_all({x}, '{T.DATE}')), lambda q: replace(q, ' ', ''))))"
_OVER = f"""(SELECT a.event_id AS a_id, b.event_id AS b_id, b.event_type, a.e - a.s AS long, least(a.e, b.e) - greatest(a.s, b.s) AS ms FROM {_SPANS} a JOIN {_SPANS} b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e WHERE a.event_type = 'view')"""
_VOC = f"(SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_TOK}')) AS token FROM conversations) GROUP BY token)"

SQL = {
    "fullwidth_token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{_TOK}')) AS token FROM documents) GROUP BY token",
    "fact_coverage": f"""WITH x AS (SELECT doc_id, {_FACTS('text')} AS f, {_FACTS('substr(text, 1, 200)')} AS h FROM documents)
        SELECT doc_id, CAST(len(f) AS BIGINT) AS n, CAST(len(list_filter(f, lambda q: list_contains(h, q))) AS BIGINT) AS covered, array_to_string(list_filter(f, lambda q: NOT list_contains(h, q)), '|') AS missed FROM x WHERE len(f) > 0""",
    "cleaned_texts": r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))) AS cleaned_md5 FROM documents",
    "layer_families": r"SELECT regexp_replace(p_brand, '([.#])\d+', '\1*') AS family, count(*) AS n, min(CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT)) AS lowest, max(CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT)) AS highest FROM part GROUP BY 1",
    "loop_flags": r"""WITH c AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\s+', '', 'g'), '') AS x FROM conversations)
        SELECT conv_id, turn, contains(array_to_string(list_transform(range(4, len(x) + 1), lambda i: CASE WHEN x[i] = x[i - 3] THEN '1' ELSE '0' END), ''), '111111') AS "loop" FROM c""",
    "turn_likeness": f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{_TOK}') AS t FROM conversations), p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)
        SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(b, t))) = 0 THEN 0 ELSE len(list_filter(list_distinct(t), lambda q: list_contains(b, q))) / len(list_distinct(list_concat(b, t))) END, 6) AS likeness FROM p WHERE b IS NOT NULL""",
    "joined_turns": """WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
        SELECT conv_id, turn, length(rtrim(b)) + length(ltrim(text)) + CASE WHEN rtrim(b) = '' OR ltrim(text) = '' THEN 0 ELSE 1 END AS n_chars FROM p WHERE b IS NOT NULL""",
    "padded_lengths": """WITH c AS (SELECT conv_id, list(length(text) ORDER BY turn) AS n FROM conversations GROUP BY conv_id)
        SELECT conv_id, array_to_string(list_concat(n[greatest(len(n) - 5, 1):len(n)], list_transform(range(6 - least(len(n), 6)), lambda x: -1)), ',') AS lengths FROM c""",
    "position_weights": """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, CASE WHEN l_quantity = 1 THEN -100 ELSE l_quantity END AS x FROM lineitem),
        p AS (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, x) AS b FROM l)
        SELECT l_orderkey, string_agg(CASE WHEN q = 1 THEN '0.0' WHEN q = 50 OR coalesce(b = 50, false) THEN '4.0' ELSE '1.0' END, ',' ORDER BY l_linenumber, x) AS weights FROM p GROUP BY l_orderkey""",
    "metadata_confidence": """SELECT event_type, count(*) AS n FROM events WHERE TRY_CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) >= 50 GROUP BY event_type""",
    "column_or_metadata": """SELECT event_id, user_id FROM events WHERE event_type = 'view' AND regexp_extract(props, '"k": *(-?[0-9.]+)', 1) = '7'""",
    "two_pass_agreement": f"SELECT conv_id, CAST(len(a) - len(b) AS BIGINT) AS edits, CAST(len(a) AS BIGINT) AS n_a, CASE WHEN len(a) = 0 THEN len(b) = 0 ELSE (len(a) - len(b)) / len(a) <= 0.12 END AS agree FROM {_TWO}",
    "mer_per_conversation": f"""SELECT conv_id, CAST(len(a) - len(b) AS BIGINT) AS edits, CAST(len(a) AS BIGINT) AS n_ref, CAST(len(b) AS BIGINT) AS n_hyp, CASE WHEN len(a) = 0 THEN 0.0 ELSE (len(a) - len(b)) / len(a) END AS mer,
        CASE WHEN len(a) = 0 THEN true ELSE (len(a) - len(b)) / len(a) <= 0.12 END AS passed FROM {_TWO}""",
    "selected_records": "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND source IS NOT NULL AND n_chars BETWEEN 300 AND 5000 ORDER BY doc_id LIMIT 40",
    "fused_segments": f"""WITH b AS (SELECT a_id, event_type, CAST(sum(ms) AS BIGINT) AS ms, any_value(long) AS long FROM {_OVER} WHERE event_type <> 'view' GROUP BY ALL), t AS (SELECT *, CAST(sum(ms) OVER (PARTITION BY a_id) AS BIGINT) AS total FROM b),
        f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY ms DESC, event_type) = 1)
        SELECT a_id, event_type, ms, total FROM f WHERE long BETWEEN 300000 AND 5400000 AND ms >= total * 0.5 AND total >= long * 0.3""",
    "usable_conversations": """SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS speakers, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
        GROUP BY conv_id HAVING count(*) >= 3 AND count(DISTINCT role) >= 2 AND sum(length(text)) >= 200""",
    "excluded_names": "SELECT c_nationkey, count(*) AS n FROM customer WHERE NOT regexp_matches(c_name, '(00|11)[0-9]$') AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY c_nationkey",
    "without_noise": """SELECT shard, count(*) AS n FROM (SELECT text, 'documents' AS shard FROM documents UNION ALL SELECT text, 'conversations' FROM conversations) WHERE NOT (contains(text, '@') OR contains(text, '#')) GROUP BY shard""",
    "usable_records": "SELECT role, CAST(sum(CASE WHEN u THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT role, conv_id, bool_or(NOT starts_with(text, 'T')) AS u FROM conversations GROUP BY ALL) GROUP BY role",
    "sampled_segments": f"SELECT conv_id, pos, speaker FROM {_SEGS} WHERE e - s BETWEEN 4000 AND 20000 AND length(text) >= 15 ORDER BY md5('seed-7:' || conv_id || ':' || pos), conv_id, pos LIMIT 25",
    "shortest_demo": """WITH e AS (SELECT event_type, event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS sec FROM events) SELECT event_type, event_id, sec FROM e WHERE sec BETWEEN 3600 AND 40000
        QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY sec, event_id) = 1""",
    "window_core": f"""WITH m AS (SELECT (s + e) // 2 AS mid FROM {_SPANS}), w AS (SELECT mid, unnest(range(greatest((mid - 7200000) // 3600000 + 1, 0), mid // 3600000 + 1)) * 3600000 AS w FROM m)
        SELECT w, count(*) AS n FROM w WHERE mid >= w + 1800000 AND mid < w + 5400000 GROUP BY w""",
    "valid_timelines": f"""WITH x AS (SELECT conv_id, pos, CASE WHEN pos % 11 = 7 THEN s - 5000 ELSE s END AS s, e FROM {_SEGS}), y AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY pos) AS b FROM x)
        SELECT conv_id, bool_and(s >= coalesce(b, s) AND s >= 0 AND s < e AND e <= 600000) AS valid FROM y GROUP BY conv_id""",
    "overlap_or_own_label": f"""WITH o AS (SELECT a_id, b_id FROM {_OVER} WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY ms DESC, b_id) = 1)
        SELECT v.event_id AS a_id, coalesce(o.b_id, v.event_id) AS label_id FROM events v LEFT JOIN o ON o.a_id = v.event_id WHERE v.event_type = 'view'""",
    "shifted_and_clipped": f"SELECT conv_id, pos, greatest(s - 20000, 0) AS from_ms, least(e - 20000, 60000) AS to_ms FROM {_SEGS} WHERE e - 20000 > 0 AND s - 20000 < 60000",
    "merged_regions": f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e, event_type) AS n FROM {_SPANS}),
        f AS (SELECT user_id, n, 1::BIGINT AS region, event_type, s, e FROM o WHERE n = 1
            UNION ALL SELECT o.user_id, o.n, CASE WHEN f.event_type = o.event_type AND o.s <= f.e + 3600000 THEN f.region ELSE f.region + 1 END, o.event_type, o.s,
                CASE WHEN f.event_type = o.event_type AND o.s <= f.e + 3600000 THEN greatest(f.e, o.e) ELSE o.e END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)
        SELECT user_id, region, event_type, min(s) AS first_ms, max(e) AS last_ms, count(*) AS n FROM f GROUP BY ALL""",
    "text_smoothing": """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        v AS (SELECT a.user_id, a.event_id, b.event_type, count(*) AS k FROM e a JOIN e b ON b.user_id = a.user_id AND b.n BETWEEN a.n - 1 AND a.n + 1 GROUP BY ALL)
        SELECT user_id, event_id, event_type FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY k DESC, event_type) = 1""",
    "first_rule_wins": "SELECT CASE WHEN contains(upper(p_type), 'STEEL') OR contains(upper(p_type), 'BRASS') THEN 'metal' WHEN contains(upper(p_type), 'SMALL') THEN 'small' WHEN contains(upper(p_type), 'PROMO') THEN 'promo' ELSE 'other' END AS kind, count(*) AS n FROM part GROUP BY 1",
    "run_parity": f"SELECT conv_id, CAST(least(len(a), len(b)) AS BIGINT) AS n, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i])) AS BIGINT) AS same FROM {_TWO}",
    "recordings_on_disk": "SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good FROM documents JOIN labels USING (doc_id) WHERE doc_id IN (SELECT vec_id FROM embeddings) GROUP BY lang",
    "roster_prompt": """WITH c AS (SELECT conv_id, role, max(turn) AS last, arg_max(substr(text, 1, 20), turn) AS snippet FROM conversations GROUP BY ALL)
        SELECT conv_id, string_agg(role || ': ' || snippet, chr(10) ORDER BY last DESC, role) AS roster FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY last DESC, role) <= 12) GROUP BY conv_id""",
    "mode_smoothing": """WITH e AS (SELECT user_id, event_id, event_id * 7 % 5 AS label, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        v AS (SELECT a.user_id, a.event_id, b.label, count(*) AS k FROM e a JOIN e b ON a.user_id = b.user_id AND b.n BETWEEN a.n - 2 AND a.n + 2 GROUP BY ALL),
        f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY k DESC, label) = 1) SELECT user_id, label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM f GROUP BY ALL""",
    "pooled_clips": f"""WITH p AS (SELECT user_id, e - s AS ms, 50000000 - coalesce(sum(e - s) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM {_SPANS}),
        u AS (SELECT user_id, greatest(least(ms, room), 0) AS used FROM p) SELECT user_id, count(*) AS clips, CAST(sum(used) AS BIGINT) AS used_ms FROM u WHERE used > 0 GROUP BY user_id""",
    "merged_notes": """WITH f AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, lower(substr(text, 1, 12)) ORDER BY turn) = 1)
        SELECT conv_id, role, turn FROM f QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) <= 3""",
    "position_shards": "SELECT lang, shard, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM (SELECT lang, doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4 AS INT) AS shard FROM documents) GROUP BY ALL",
    "vocabulary_report": f"""WITH f AS (SELECT DISTINCT lower(n_name) AS token, true AS forced FROM nation), v AS (SELECT coalesce(n, 0) AS n, coalesce(forced, false) OR coalesce(n, 0) >= 3 AS kept FROM {_VOC} FULL JOIN f USING (token))
        SELECT kept, count(*) AS kinds, CAST(sum(n) AS BIGINT) AS tokens FROM v GROUP BY kept""",
    "dropped_tokens": f"SELECT token, n FROM {_VOC} WHERE n < 3 ORDER BY n DESC, token LIMIT 100",
    "window_health": """WITH k AS (SELECT conv_id, max(k) AS max_repeat, count(*) AS kinds FROM (SELECT conv_id, text, count(*) AS k FROM conversations GROUP BY ALL) GROUP BY conv_id),
        n AS (SELECT conv_id, count(*) AS n, count(DISTINCT role) AS speakers, quantile_cont(length(text), 0.5) AS median_chars, CAST(sum(length(text) - length(replace(text, '.', ''))) AS BIGINT) AS marks FROM conversations GROUP BY conv_id)
        SELECT conv_id, n, speakers, median_chars, marks, max_repeat, round(1 - kinds / n, 6) AS repeated FROM n JOIN k USING (conv_id)""",
    "speaker_histogram": "SELECT speakers, count(*) AS n FROM (SELECT conv_id, count(DISTINCT role) AS speakers FROM conversations GROUP BY conv_id) GROUP BY speakers",
    "uneven_cells": "SELECT user_id, max(n) AS most, min(n) AS fewest FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id HAVING max(n) - min(n) > greatest(2, max(n) * 0.25)",
    "sweep_report": """WITH p AS (SELECT p_brand, sum(p_retailprice) AS total, avg(p_size) AS size, count(*) AS n FROM part GROUP BY p_brand)
        SELECT p_brand, round(total, 2) AS total, round(size, 6) AS size, n, row_number() OVER (ORDER BY n DESC, size, p_brand) AS place FROM p QUALIFY place <= 12""",
    "loss_means": "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / greatest(sum(l_discount), 1e-8), 4) AS mean FROM lineitem GROUP BY l_returnflag",
    "top_indices": "SELECT label, string_agg(vec_id, ',' ORDER BY vec_id) AS ids FROM (SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) <= 3) GROUP BY label",
    "selected_heads": """WITH n AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT event_type FROM n GROUP BY event_type ORDER BY sum(n) DESC, event_type LIMIT 2)
        SELECT event_type, user_id, n FROM n WHERE event_type IN (SELECT event_type FROM g) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) <= 3""",
    "best_thresholds": """WITH s AS (SELECT event_type, t, CAST(sum(CASE WHEN value >= t THEN t ELSE -1 END) AS BIGINT) AS score FROM events, range(0, 100, 10) g(t) GROUP BY ALL)
        SELECT event_type, t, score FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY score DESC, t) = 1""",
    "threshold_gates": """WITH m AS (SELECT lang, quality, toxic, CASE WHEN n_chars > 0 THEN n_chars ELSE 1 END AS w FROM documents JOIN labels USING (doc_id)),
        g AS (SELECT 'quality' AS gate, sum(quality * w) / sum(w) AS value, 0.5::DOUBLE AS "limit", count(*) AS n FROM m UNION ALL SELECT 'toxic', sum(toxic * w) / sum(w), 0.2, count(*) FROM m
        UNION ALL SELECT 'de_quality', sum(quality * w) / sum(w), 0.9, count(*) FROM m WHERE lang = 'de' UNION ALL SELECT 'fr_toxic', sum(toxic * w) / sum(w), 0.01, count(*) FROM m WHERE lang = 'fr')
        SELECT gate, round(value, 6) AS value, "limit", n, value <= "limit" AS passed FROM g""",
    "stage_gates": """WITH e AS (SELECT event_type, count(*) AS n, avg(value) AS mean, max(value) AS largest FROM events GROUP BY event_type)
        SELECT event_type, 'n' AS figure, n >= 10 AS passed FROM e UNION ALL SELECT event_type, 'mean', mean <= 60 FROM e UNION ALL SELECT event_type, 'largest', largest <= 400 FROM e""",
}

ROWS_ONLY = ["fidelity_reports", "release_gates"]
QUERIES: dict = {name: globals()[name] for name in [*SQL, *ROWS_ONLY]}
