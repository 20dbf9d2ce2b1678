"""Yearly catalogs, dialogue scripts and audio tables, read as Spark reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A catalog's fields and what they are called in a record's metadata.
META = {
    "ivod_id": "IVOD_ID", "ivod_url": "IVOD_URL", "video_url": "video_url", "committee": "會議資料", "legislator": "委員名稱",
    "video_length": "影片長度", "speaking_window": "委員發言時間", "features": "支援功能",
}
SCRIPT = "struct<speakers:array<string>,turns:array<struct<speaker:string,text:string>>,domain:string,language:string>"
LANGUAGE = "zh-TW-en"


def read_catalog(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, record)``: the lines of catalog files that are JSON, as variants; others are passed over."""
    lines = spark.read.text(list(paths)).select(F.input_file_name().alias("path"), F.trim("value").alias("value"))
    return lines.where("value <> ''").select("path", F.try_parse_json("value").alias("record")).where("record is not null")


def catalog_meta(record: Column) -> Column:
    """A catalog record's metadata as JSON: renamed fields, and of the transcript two recognisers' lists."""
    field = lambda path: F.try_variant_get(record, path, "variant")
    named = [field(f"$['{name}']").alias(out) for out, name in META.items()]
    heard = F.struct(field("$.transcript.pyannote").alias("pyannote"), field("$.transcript.whisperx").alias("whisperx"))
    return F.to_json(F.struct(*named, heard.alias("transcript")))


def read_scripts(spark: SparkSession, *paths: str) -> DataFrame:
    """``(speakers, turns, domain, language)`` of dialogue scripts, one a line; the language may be left out."""
    lines = spark.read.text(list(paths)).where(F.trim("value") != "")
    s = lines.select(F.from_json("value", SCRIPT).alias("s")).where("s.speakers is not null and s.turns is not null and s.domain is not null")
    return s.select("s.speakers", "s.turns", "s.domain", F.coalesce("s.language", F.lit(LANGUAGE)).alias("language"))


def read_clips(spark: SparkSession, *paths: str, language: str | None = None, most_s: float | None = None) -> DataFrame:
    """``(language, duration, transcription, bytes)`` of Parquet tables of sound.

    Filters reach the scan, and only the four columns are read.
    """
    rows = spark.read.parquet(*paths)
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if most_s is not None:
        rows = rows.where(F.col("duration") <= most_s)
    return rows.select("language", "duration", "transcription", F.col("audio.bytes").alias("bytes"))


def augmented(records: DataFrame, path: Column, meta: str = "meta") -> DataFrame:
    """Records of another file of the same sound: the path replaced, the metadata marked."""
    added = F.from_json(F.coalesce(meta, F.lit("{}")), "map<string,string>")
    marked = F.when(F.trim(meta).isin("{}", "") | F.col(meta).isNull(), F.lit('{"augmented":true}')).otherwise(F.concat(F.regexp_replace(F.rtrim(meta), r"\}$", ""), F.lit(',"augmented":true}')))
    return records.withColumns({"audio_path": path, meta: F.when(added.isNotNull(), marked).otherwise(F.col(meta))})


def title_of(domain: Column, topic: Column) -> Column:
    return F.concat(domain, F.lit("："), topic)
