"""Named queries of converted texts, notes and models' logits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import converter, metrics, notes, probes, shaping
from colloquy.plans.catalog import _t, segments

#: Turns of a window of notes; letters that pairs of are phrases; parts that a row of logits is cut into.
WINDOW, PARTS = 2, 4
_OTHER = "[^A-Za-z0-9 .,'-]+"


def phrase_table(spark, d) -> DataFrame:
    """Letters outside of ASCII under a mark, and pairs of them that some turn begins a run with, turned round."""
    runs = _t(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_OTHER), F.lit(0))).alias("r"))
    letters = runs.select(F.explode(F.split("r", "")).alias("phrase")).where("phrase <> ''").select("phrase", F.concat(F.lit("^"), "phrase").alias("to"))
    pairs = runs.where(F.length("r") >= 2).select(F.substring("r", 1, 2).alias("phrase")).select("phrase", F.concat(F.lit("<"), F.reverse("phrase"), F.lit(">")).alias("to"))
    return letters.unionByName(pairs).distinct()


def converted_turns(spark, d):
    convert = converter.converter([phrase_table(spark, d)], [("<", "("), ("è>", "é>")])
    return _t(spark, d, "conversations").select("conv_id", "turn", F.md5(convert(F.col("text")).cast("binary")).alias("text_md5"))


def templated(spark, d) -> DataFrame:
    """Turns that begin with what marks topics, actions or facts, some with the same words."""
    c = _t(spark, d, "conversations")
    kind = (F.col("conv_id") * 5 + F.col("turn") * 3) % 7
    cue = F.element_at(F.array(*map(F.lit, ["Agenda", "agenda:", "we follow up", "about 75%", "負責 agenda", "[note]", "we talk"])), (kind + 1).cast("int"))
    again = (F.col("conv_id") + F.col("turn")) % 3 == 0
    text = F.concat(cue, F.lit("  "), F.when(again, "the same words each time").otherwise(F.coalesce("text", F.lit(""))))
    return c.select("conv_id", F.floor(F.col("turn") / WINDOW).cast("long").alias("window"), "turn", "role", text.alias("text"))


def _notes(spark, d) -> DataFrame:
    return notes.window_notes(templated(spark, d), ["conv_id", "window"], "turn", "role", "text")


def window_notes(spark, d):
    return _notes(spark, d).select("conv_id", "window", F.size("notes").cast("long").alias("lines"), F.md5(F.array_join("notes", "\n").cast("binary")).alias("notes_md5"))


def whole_notes(spark, d):
    """All turns of a conversation as one window, so that the caps are reached."""
    n = notes.window_notes(templated(spark, d), ["conv_id"], "turn", "role", "text")
    return n.select("conv_id", F.size("notes").cast("long").alias("lines"), F.md5(F.array_join("notes", "\n").cast("binary")).alias("notes_md5"))


def meeting_summaries(spark, d):
    s = notes.merged_notes(_notes(spark, d), "conv_id", "window", F.concat(F.lit("conversation "), F.col("conv_id").cast("string")))
    return s.select("conv_id", F.md5(F.col("summary").cast("binary")).alias("summary_md5"))


# ---------------------------------------------------------------- logits
def logits(spark, d) -> DataFrame:
    """A vector as a teacher's logits, a shaken one as the candidate's, in parts of the vocabulary."""
    e = _t(spark, d, "embeddings")
    teacher = F.transform("embedding", lambda x: x.cast("double") * 8)
    shaken = F.transform("t", lambda x, i: x + ((F.col("vec_id") * 31 + i * 17) % 13).cast("double") / 10 - 0.6)
    whole = e.select("vec_id", "label", teacher.alias("t")).withColumn("c", shaken)
    size = 64 // PARTS
    cut = whole.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("p"), "t", "c")
    part = lambda x: F.slice(x, F.col("p") * size + 1, F.lit(size))
    return cut.select("vec_id", (F.col("vec_id") % 64).alias("gold"), (F.col("p") * size).alias("first"), part("t").alias("t"), part("c").alias("c"))


def probe_report(spark, d):
    rows = probes.compared(logits(spark, d), ["vec_id"], "first", "t", "c")
    forced = _t(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).cast("long").alias("clip"), (F.col("vec_id") * 7 % 64).alias("forced"))
    return probes.probe_report(rows.join(forced, "vec_id"), "clip", "forced", F.col("vec_id") % 4 == 1)


def boundary_margins(spark, d):
    m = probes.boundary_margins(logits(spark, d), ["vec_id"], "first", "t", "gold", 5)
    return probes.margin_report(m.withColumn("clip", F.floor(F.col("vec_id") / 250).cast("long")), "clip")


# ---------------------------------------------------------------- segments and hypotheses
def dense_segments(spark, d):
    """Turns whose stops are spelt as ideographic ones, cut at the pace of their own speech."""
    s = segments(spark, d).withColumn("text", F.translate("text", ".,", "。，"))
    # cutting costs far more than a row's bytes tell, so the rows are dealt out before it
    s = s.repartition(spark.sparkContext.defaultParallelism, "conv_id", "pos")
    return shaping.densified(s, ["conv_id", "pos"], "text", "start", "end").select("conv_id", "pos", "piece", "start", "end", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _sentences(spark, d) -> DataFrame:
    """Sentences of turns under keys of their own."""
    s = _t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "[.\n]")).alias("n", "text"))
    return s.select("conv_id", "turn", (F.col("conv_id") * 1_000_000 + F.col("turn") * 1000 + F.col("n")).alias("key"), "text")


def _hypotheses(spark, d) -> DataFrame:
    """Sentences heard twice, the second time with words lost, changed and added; those of every fifth turn not at all."""
    c = _sentences(spark, d).where("(conv_id + turn) % 5 <> 2")
    words = F.split("text", " ")
    heard = F.flatten(F.transform(words, lambda w, i: F.when(i % 7 == 3, F.array().cast("array<string>")).when(i % 7 == 5, F.array(F.lit("zz"), w)).when(i % 11 == 6, F.array(F.lit("yy"))).otherwise(F.array(w))))
    return c.select("key", F.lit(1).alias("take"), F.lit("nothing of it").alias("text")).unionByName(c.select("key", F.lit(2).alias("take"), F.array_join(heard, " ").alias("text")))


def sentence_edits(spark, d):
    """Error rate of each sentence against the last of its hypotheses."""
    ref = _sentences(spark, d).select("key", "text")
    return metrics.mixed_error_rate(ref, _hypotheses(spark, d), "key", "take").select("key", "edits", "n_ref", "n_hyp", F.round("mer", 6).alias("mer"))


def missing_hypotheses(spark, d):
    return metrics.paired(_sentences(spark, d), _hypotheses(spark, d), "key")


_TOK = T.TOKEN.replace("'", "''")
_SEGS = """(SELECT conv_id, turn AS pos, translate(text, '.,', '。，') AS text, e - l AS s, e FROM (SELECT *, CAST(sum(l) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e
    FROM (SELECT *, CAST(greatest(length(text) * 80, 300) AS BIGINT) AS l FROM conversations)))"""
_SENTENCES = r"(SELECT conv_id, turn, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS text FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.\n]') AS x FROM conversations))"
_CUES = "['Agenda', 'agenda:', 'we follow up', 'about 75%', '負責 agenda', '[note]', 'we talk']"
_ANY = lambda cues: " OR ".join(f"contains(t, '{c}')" for c in cues)
_FACT = " OR ".join(f"regexp_matches(t, '{p}')" for p in (T.PERCENT, T.AMOUNT, T.DATE))


def _note_sql(keys: str) -> str:
    """The lines of each window folded one by one."""
    return f"""l0 AS (SELECT conv_id, turn // {WINDOW} AS "window", turn, role, ({_CUES})[((conv_id * 5 + turn * 3) % 7 + 1)::INT] || '  ' || CASE WHEN (conv_id + turn) % 3 = 0 THEN 'the same words each time' ELSE coalesce(text, '') END AS t FROM conversations),
        l1 AS (SELECT {keys}, turn, role, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM l0),
        l AS MATERIALIZED (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY turn) AS n, role || ': ' || t AS said, t,
            substr(regexp_replace(regexp_replace(t, '^[^:：]*[:：]', ''), '[\\d\\s]', '', 'g'), 1, {notes.SIGN}) AS sig, t <> '' AND NOT starts_with(t, '[') AS use,
            {_ANY(notes.TOPIC_CUES)} AS topic, {_ANY(notes.ACTION_CUES)} OR contains(lower(t), 'follow up') AS action, {_FACT} AS fact FROM l1),
        f AS (SELECT DISTINCT {keys}, 0::BIGINT AS n, []::VARCHAR[] AS topics, []::VARCHAR[] AS points, []::VARCHAR[] AS actions, []::VARCHAR[] AS signs FROM l
            UNION ALL SELECT {keys}, n, CASE WHEN k = 1 THEN list_append(topics, t) ELSE topics END, CASE WHEN k = 3 THEN list_append(points, said) ELSE points END,
                CASE WHEN k = 2 THEN list_append(actions, said) ELSE actions END, CASE WHEN k > 0 THEN list_append(signs, sig) ELSE signs END
            FROM (SELECT f.* REPLACE (l.n AS n), l.t, l.said, l.sig, CASE WHEN NOT l.use OR list_contains(f.signs, l.sig) THEN 0 WHEN l.topic AND len(f.topics) < {notes.TOPICS} THEN 1 WHEN l.action THEN 2 WHEN l.fact THEN 3 ELSE 0 END AS k
                FROM f JOIN l USING ({keys}) WHERE l.n = f.n + 1)),
        done AS (SELECT {keys}, list_concat(list_transform(topics[:2], lambda x: '[主題] ' || x), list_transform(points[:6], lambda x: '[重點] ' || x), list_transform(actions[:6], lambda x: '[待辦] ' || x)) AS notes
            FROM f QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1),
        notes AS (SELECT {keys}, CASE WHEN len(notes) > 0 THEN notes ELSE ['{notes.NOTHING}'] END AS notes FROM done)"""


_LOGITS = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 8) AS t FROM embeddings), w AS (SELECT vec_id, t, list_transform(t, lambda x, i: x + ((vec_id * 31 + (i - 1) * 17) % 13)::DOUBLE / 10 - 0.6) AS c FROM v)"""
_REST = "list_max(list_filter(t, lambda x, i: i <> 6))"

SQL = {
    "converted_turns": f"""WITH RECURSIVE p AS MATERIALIZED (SELECT conv_id, turn, unnest(x) AS part, generate_subscripts(x, 1) AS n FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{_OTHER.replace("'", "''")}|[A-Za-z0-9 .,''-]+') AS x FROM conversations)),
        r AS MATERIALIZED (SELECT DISTINCT part FROM p WHERE NOT regexp_matches(part, '^[A-Za-z0-9 .,''-]')), pairs AS MATERIALIZED (SELECT DISTINCT left(part, 2) AS phrase FROM r WHERE length(part) >= 2),
        w AS (SELECT part, 1::BIGINT AS place, '' AS done FROM r
            UNION ALL SELECT part, place + CASE WHEN phrase IS NULL THEN 1 ELSE 2 END, done || CASE WHEN phrase IS NULL THEN '^' || part[place:place] ELSE '<' || reverse(phrase) || '>' END
            FROM w LEFT JOIN pairs ON phrase = substr(part, place, 2) AND length(substr(part, place, 2)) = 2 WHERE place <= length(part)),
        m AS (SELECT part, replace(replace(done, '<', '('), 'è>', 'é>') AS done FROM w WHERE place > length(part)),
        j AS (SELECT conv_id, turn, string_agg(coalesce(done, part), '' ORDER BY n) AS text FROM p LEFT JOIN m USING (part) GROUP BY ALL)
        SELECT conv_id, turn, CASE WHEN c.text IS NOT NULL THEN md5(coalesce(j.text, '')) END AS text_md5 FROM conversations c LEFT JOIN j USING (conv_id, turn)""",
    "window_notes": f"""WITH RECURSIVE {_note_sql('conv_id, "window"')} SELECT conv_id, "window", len(notes) AS lines, md5(array_to_string(notes, chr(10))) AS notes_md5 FROM notes""",
    "whole_notes": f"""WITH RECURSIVE {_note_sql("conv_id")} SELECT conv_id, len(notes) AS lines, md5(array_to_string(notes, chr(10))) AS notes_md5 FROM notes""",
    "meeting_summaries": f"""WITH RECURSIVE {_note_sql('conv_id, "window"')},
        o AS (SELECT conv_id, "window", unnest(notes) AS l, generate_subscripts(notes, 1) AS p FROM notes),
        u AS (SELECT conv_id, l, left(l, 4) AS k, min("window" * 1000 + p) AS place FROM o GROUP BY ALL),
        n AS (SELECT *, trim(substr(l, 5)) AS s, row_number() OVER (PARTITION BY conv_id, k ORDER BY place) AS r FROM u),
        g AS (SELECT conv_id, string_agg(s, '；' ORDER BY r) FILTER (k = '[主題]' AND r <= 3) AS a, string_agg('• ' || s, chr(10) ORDER BY r) FILTER (k = '[重點]' AND r <= 8) AS b, string_agg('- ' || s, chr(10) ORDER BY r) FILTER (k = '[待辦]' AND r <= 8) AS c FROM n GROUP BY conv_id)
        SELECT conv_id, md5(concat_ws(chr(10), '[標題] conversation ' || conv_id, '[摘要]', '議題：' || a, b, '待辦事項：' || chr(10) || c)) AS summary_md5 FROM g""",
    "probe_report": f"""WITH {_LOGITS}, s AS (SELECT vec_id, t, c, list_max(t) + ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t))))) AS lt, list_max(c) + ln(list_sum(list_transform(c, lambda x: exp(x - list_max(c))))) AS lc FROM w),
        r AS (SELECT vec_id, list_sum(list_transform(list_zip(t, c), lambda z: exp(z[1] - lt) * ((z[1] - lt) - (z[2] - lc)))) AS kl, list_position(c, list_max(c)) - 1 AS best, list_reverse_sort(c)[1] - list_reverse_sort(c)[2] AS margin, CASE WHEN list_position(c, list_max(c)) - 1 = vec_id * 7 % 64 THEN 100.0 ELSE 0.0 END AS hit FROM s)
        SELECT vec_id // 50 AS clip, round(avg(kl), 4) AS kl, round(avg(hit)::DOUBLE, 2) AS agree, round(avg(margin) FILTER (vec_id % 4 = 1), 3) AS s_margin, round((avg(hit) FILTER (vec_id % 4 = 1))::DOUBLE, 2) AS s_agree FROM r GROUP BY 1""",
    "boundary_margins": f"""WITH {_LOGITS}, m AS (SELECT vec_id // 250 AS clip, vec_id % 64 = 5 AS positive, CASE WHEN vec_id % 64 = 5 THEN t[6] - {_REST} ELSE t[vec_id % 64 + 1] - t[6] END AS margin FROM w)
        SELECT clip, positive, count(*) AS n, round(quantile_cont(margin, 0.5), 6) AS median, count(*) FILTER (margin < 0.5) AS narrow FROM m GROUP BY ALL""",
    "dense_segments": f"""WITH s AS (SELECT *, CASE WHEN e - s > 8000 AND length(text) >= 40 THEN greatest(length(text) * 8000 // (e - s), 20) END AS z FROM {_SEGS}),
        p AS (SELECT *, flatten(list_transform(regexp_extract_all(text, '[^。！？!?;；]+[。！？!?;；]?'), lambda x: CASE WHEN length(x) <= z * 1.5 THEN [x] ELSE flatten(list_transform(regexp_extract_all(x, '[^，,、]+[，,、]?'),
            lambda c: list_transform(range(0, greatest(ceil((length(c) - z * 1.5) / z), 0)::BIGINT + 1), lambda k: CASE WHEN k < greatest(ceil((length(c) - z * 1.5) / z), 0) THEN substr(c, k * z + 1, z) ELSE substr(c, k * z + 1) END))) END)) AS p FROM s),
        m AS (SELECT *, CASE WHEN z IS NULL OR len(p) = 0 THEN [text] ELSE string_split(list_reduce(p, lambda a, x: CASE WHEN length(list_last(string_split(a, chr(1)))) + length(x) <= z THEN a || x ELSE a || chr(1) || x END), chr(1)) END AS q FROM p),
        o AS (SELECT *, CASE WHEN len(q) = 1 THEN [text] ELSE q END AS g FROM m),
        u AS (SELECT conv_id, pos, s, e, unnest(g) AS x, generate_subscripts(g, 1) - 1 AS piece, len(g) AS n FROM o),
        a AS (SELECT *, sum(length(x)) OVER (PARTITION BY conv_id, pos ORDER BY piece) AS upto, sum(length(x)) OVER (PARTITION BY conv_id, pos) AS whole FROM u)
        SELECT conv_id, pos, piece::INT AS piece, CASE WHEN piece = 0 THEN s ELSE s + ((e - s) * (upto - length(x)) // whole)::BIGINT END AS "start", CASE WHEN piece = n - 1 THEN e ELSE s + ((e - s) * upto // whole)::BIGINT END AS "end", md5(x) AS text_md5 FROM a""",
    "sentence_edits": f"""WITH RECURSIVE t AS (SELECT conv_id * 1000000 + turn * 1000 + n AS key, text, (conv_id + turn) % 5 <> 2 AS heard FROM {_SENTENCES}),
        h AS (SELECT key, text, CASE WHEN heard THEN array_to_string(flatten(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN (i - 1) % 7 = 3 THEN [] WHEN (i - 1) % 7 = 5 THEN ['zz', w] WHEN (i - 1) % 11 = 6 THEN ['yy'] ELSE [w] END)), ' ') ELSE '' END AS hyp FROM t),
        k AS MATERIALIZED (SELECT key, regexp_extract_all(lower(text), '{_TOK}') AS a, regexp_extract_all(lower(hyp), '{_TOK}') AS b FROM h),
        d AS (SELECT key, 0::BIGINT AS i, range(0, len(b) + 1) AS cells FROM k
            UNION ALL SELECT key, d.i + 1, list_transform(range(0, len(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda m: (CASE WHEN m = 0 THEN d.i + 1 ELSE least(cells[m + 1] + 1, cells[m] + CASE WHEN a[d.i + 1] = b[m] THEN 0 ELSE 1 END) END) + j - m)))
            FROM d JOIN k USING (key) WHERE d.i < len(a))
        SELECT key, cells[-1] AS edits, len(a)::INT AS n_ref, len(b)::INT AS n_hyp, round(CASE WHEN len(a) > 0 THEN cells[-1] / len(a) WHEN len(b) > 0 THEN 1.0 ELSE 0.0 END, 6) AS mer FROM d JOIN k USING (key) WHERE i = len(a)""",
    "missing_hypotheses": f"SELECT count(*) AS n_records, count(*) FILTER ((conv_id + turn) % 5 = 2) AS n_missing FROM {_SENTENCES}",
}
QUERIES: dict = {name: globals()[name] for name in SQL}
