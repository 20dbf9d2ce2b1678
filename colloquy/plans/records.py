"""Named queries of the readers, writers and folds over records, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import stitching
from colloquy.plans.catalog import _t, segments
from colloquy.sinks.records import json_target, start_marks
from colloquy.sources import generated, manifests, tables
from colloquy.streaming import speakers

WINDOW_MS, OVERLAP_MS = 60_000, 20_000
#: Vectors of one made-up recording, so that their number grows with the table.
RECORDING = 100


def _label() -> Column:
    return F.format_string("S%02d", F.length("speaker") % 9 + 1)


def _plain(segs: DataFrame) -> DataFrame:
    return segs.withColumn("text", F.trim(F.translate("text", "[]\n\r\t", "     ")))


def _array(segs: DataFrame) -> DataFrame:
    """One row a conversation with its segments in order, times in seconds."""
    item = F.struct("pos", (F.col("start") / 1000).alias("start"), (F.col("end") / 1000).alias("end"), "speaker", F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["speaker"].alias("speaker"), s["text"].alias("text")))
    return segs.groupBy("conv_id").agg(ordered.alias("segments"))


def _long(rows: DataFrame) -> DataFrame:
    """Segments of ``rows`` one by one, times in whole ms again, texts as digests."""
    s = rows.select("conv_id", F.posexplode("segments").alias("pos", "s"))
    return s.select("conv_id", "pos", *_cells("s."))


def _cells(of: str = "") -> list[Column]:
    ms = lambda c: F.round(F.col(of + c) * 1000).cast("bigint")
    return [ms("start").alias("start_ms"), ms("end").alias("end_ms"), F.col(of + "speaker").alias("speaker"), F.md5(F.col(of + "text").cast("binary")).alias("text_md5")]


def manifest_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as lines and read again; lines of 3, 6, 9 ... segments are cut off and lost."""
    rec = _array(segments(spark, d)).select(
        "conv_id", F.concat(F.col("conv_id").cast("string"), F.lit(".wav")).alias("audio_path"), F.coalesce(F.element_at("segments", -1)["end"], F.lit(0.0)).alias("duration_s"),
        F.lit(16000).alias("sample_rate"), F.lit("en").alias("language"), F.lit("chat").alias("source"), F.lit("train").alias("split"), "segments",
    )
    line = manifests.manifest_line(rec.columns)
    cut = F.when(F.size("segments") % 3 == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    got = manifests.parsed(rec.select("conv_id", cut.alias("value"))).where("good")
    return got.select("conv_id", "audio_path", F.size("segments").cast("long").alias("n"), F.round(F.col("duration_s") * 1000).cast("bigint").alias("end_ms"))


def json_targets(spark, d):
    """Segments rendered as JSON behind a chat wrapper and read again."""
    rows = _array(segments(spark, d)).select("conv_id", F.concat(F.lit("<|im_start|>assistant "), json_target(F.col("segments")), F.lit("<|im_end|>")).alias("said"))
    return _long(rows.select("conv_id", generated.generated_segments(F.col("said")).alias("segments")))


def _marked(spark, d, closed: bool) -> DataFrame:
    """Marker texts; two labels of three are left out and must be carried forward."""
    s = _plain(segments(spark, d)).withColumn("tag", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("["), _label(), F.lit("]"))).otherwise(""))
    mark = lambda c: F.format_string("[%.2f]", F.col(c) / 1000)
    piece = F.concat(mark("start"), "tag", F.coalesce("text", F.lit("")), *([mark("end")] if closed else []))
    said = s.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))).alias("l"))
    return said.select("conv_id", F.array_join(F.transform("l", lambda x: x["p"]), "").alias("said"))


def closed_marker_segments(spark, d):
    got = generated.closed_markers(_marked(spark, d, True), ["conv_id"], "said")
    return got.select("conv_id", *_cells())


def open_marker_segments(spark, d):
    got = generated.open_markers(_marked(spark, d, False), ["conv_id"], "said", offset=10.0)
    return got.select("conv_id", *_cells()).drop("end_ms")


def start_mark_lines(spark, d):
    rows = _array(segments(spark, d).withColumn("speaker", _label())).select("conv_id", start_marks(F.col("segments")).alias("s"))
    return rows.select("conv_id", F.md5(F.col("s").cast("binary")).alias("line_md5"))


def source_overlay(spark, d):
    """Nations, some renamed by a second list that also knows one more."""
    base = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    over = _t(spark, d, "nation").where("n_nationkey % 4 = 1").select((F.col("n_nationkey") + 5).alias("n_nationkey"), F.when(F.col("n_nationkey") % 8 == 1, F.lower("n_name")).alias("n_name"))
    return tables.overlaid(base, over, "n_nationkey")


def registry_labels(spark, d):
    """Each whole vector as the voice of one window; recordings of ``RECORDING`` windows."""
    e = _t(spark, d, "embeddings").select(F.floor(F.col("vec_id") / RECORDING).cast("bigint").alias("rec"), "vec_id", F.col("embedding").alias("v"))
    return speakers.label_windows(e, "rec", "vec_id", "v")


def windowed(segs: DataFrame) -> DataFrame:
    """A stand-in for window transcripts: segments that begin in a window, cut at its end, under
    labels that each window numbers in its own way."""
    from colloquy.operators.intervals import hops

    step = WINDOW_MS - OVERLAP_MS
    w = segs.select("conv_id", F.explode(hops(F.col("start"), WINDOW_MS, step)).alias("offset"), "start", F.col("end"), "speaker", "text")
    return w.select("conv_id", "offset", "start", F.least("end", F.col("offset") + WINDOW_MS).alias("end"), F.concat(F.lit("w"), (F.col("offset") / step % 2).cast("int").cast("string"), F.lit("-"), "speaker").alias("speaker"), "text")


def stitched_windows(spark, d):
    return stitching.stitched(windowed(segments(spark, d)), "conv_id", OVERLAP_MS)


_SEGS = """(SELECT conv_id, turn, role, text, e - l AS s, e, printf('S%02d', length(role) % 9 + 1) AS label FROM (SELECT *, CAST(sum(l) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e
    FROM (SELECT *, CAST(greatest(length(text) * 80, 300) AS BIGINT) AS l FROM conversations)))"""
_PLAIN = f"(SELECT * REPLACE (trim(translate(text, chr(91) || chr(93) || chr(10) || chr(13) || chr(9), '     ')) AS text) FROM {_SEGS})"


def _carried(only: str) -> str:
    return f"""coalesce(last_value(CASE WHEN turn % 3 = 0 AND {only} THEN label END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 'S01') AS speaker"""


SQL = {
    "manifest_round_trip": f"SELECT conv_id, conv_id || '.wav' AS audio_path, count(*) AS n, max(e) AS end_ms FROM {_SEGS} GROUP BY conv_id HAVING count(*) % 3 <> 0",
    "json_targets": f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS pos, s AS start_ms, e AS end_ms, role AS speaker, md5(coalesce(text, '')) AS text_md5 FROM {_SEGS}",
    "closed_marker_segments": f"SELECT conv_id, start_ms, end_ms, speaker, text_md5 FROM (SELECT conv_id, s AS start_ms, e AS end_ms, {_carried("text <> ''")}, md5(text) AS text_md5, text FROM {_PLAIN}) WHERE text <> ''",
    "open_marker_segments": f"SELECT conv_id, start_ms, speaker, text_md5 FROM (SELECT conv_id, s + 10000 AS start_ms, {_carried('true')}, md5(text) AS text_md5, text FROM {_PLAIN}) WHERE text <> ''",
    "start_mark_lines": f"""SELECT conv_id, md5(string_agg(printf('[%.2f][%s]%s', s / 1000, label, coalesce(text, '')), '' ORDER BY turn) || printf('[%.2f]', max(e) / 1000)) AS line_md5 FROM {_SEGS} GROUP BY conv_id""",
    "source_overlay": """SELECT coalesce(o.n_nationkey, b.n_nationkey) AS n_nationkey, coalesce(o.n_name, b.n_name) AS n_name, b.n_regionkey FROM nation b
        FULL JOIN (SELECT n_nationkey + 5 AS n_nationkey, CASE WHEN n_nationkey % 8 = 1 THEN lower(n_name) END AS n_name FROM nation WHERE n_nationkey % 4 = 1) o ON o.n_nationkey = b.n_nationkey""",
}
QUERIES = {name: globals()[name] for name in [*SQL, "registry_labels", "stitched_windows"]}
