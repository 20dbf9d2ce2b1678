"""Manifests of one JSON record a line: bad lines are set aside and never stop a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:double,end:double,speaker:string,text:string>>"
FIELDS = {"audio_path": "string", "duration_s": "double", "sample_rate": "int", "language": "string", "source": "string", "split": "string"}


def _segments(record: Column) -> Column:
    """The typed segments; none where the key is missing, null where one cannot be read."""
    given = F.try_variant_get(record, "$.segments", "variant")
    typed = F.try_variant_get(record, "$.segments", SEGMENTS)
    broken = F.exists(typed, lambda s: s["start"].isNull() | s["end"].isNull() | s["speaker"].isNull() | s["text"].isNull())
    return F.when(given.isNull(), F.array().cast(SEGMENTS)).when(~broken, typed)


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` with the fields, ``segments``, ``meta`` (JSON text) and ``good`` beside them.

    A line is good if it is JSON with every field of the right kind and only whole segments.
    Blank and null lines are left out.  Works on streams too: there is no shuffle.
    """
    rows = lines.where(F.trim(F.col(line)) != "").withColumn("_r", F.try_parse_json(line))
    for name, kind in FIELDS.items():
        rows = rows.withColumn(name, F.try_variant_get("_r", f"$.{name}", kind))
    rows = rows.withColumn("segments", _segments(F.col("_r")))
    meta = F.try_variant_get("_r", "$.meta", "variant")
    rows = rows.withColumn("meta", F.coalesce(F.to_json(meta), F.lit("{}")))
    whole = F.col("segments").isNotNull()
    for name in FIELDS:
        whole = whole & F.col(name).isNotNull()
    return rows.withColumn("good", whole).drop("_r")


def read_manifest(spark: SparkSession, *paths: str) -> DataFrame:
    """The good records of files or patterns."""
    return parsed(spark.read.text(list(paths))).where("good").drop("value", "good")


def read_rejected(spark: SparkSession, *paths: str) -> DataFrame:
    """The lines that ``read_manifest`` leaves out, with their file."""
    lines = spark.read.text(list(paths)).withColumn("path", F.input_file_name())
    return parsed(lines).where(~F.col("good")).select("path", F.col("value").alias("line"))


def manifest_line(columns: list[str]) -> Column:
    """A record as one line of JSON, keys in the fixed order; ``meta`` is JSON text or missing."""
    meta = F.coalesce(F.try_parse_json("meta"), F.parse_json(F.lit("{}"))) if "meta" in columns else F.parse_json(F.lit("{}"))
    return F.to_json(F.struct(*FIELDS, "segments", meta.alias("meta")), {"ignoreNullFields": "false"})
