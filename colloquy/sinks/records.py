"""Manifest files, rendered targets and appends that survive a restart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.sources.manifests import manifest_line, parsed


def write_manifest(records: DataFrame, path: str) -> None:
    """One line of JSON a record, UTF-8; what was there is replaced."""
    records.select(manifest_line(records.columns).alias("value")).write.mode("overwrite").text(path)


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("c")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_target(segments: Column) -> Column:
    """Segments as a compact JSON array; a whole-number label is a number, an empty one is left out."""

    def one(s):
        label = F.trim(F.coalesce(s["speaker"], F.lit("")))
        number = F.when(label.rlike("^-?[0-9]+$"), label.try_cast("decimal(38,0)").cast("string"))
        speaker = F.when(label == "", F.lit("")).otherwise(F.concat(F.lit(',"Speaker":'), F.coalesce(number, _quoted(s["speaker"]))))
        return F.concat(F.lit('{"Start":'), s["start"].cast("string"), F.lit(',"End":'), s["end"].cast("string"), speaker, F.lit(',"Content":'), _quoted(s["text"]), F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform(segments, one), ","), F.lit("]"))


def start_marks(segments: Column) -> Column:
    """``[start][label]text`` of each segment and the last end; empty for no segments."""
    body = F.transform(segments, lambda s: F.concat(F.format_string("[%.2f][", s["start"]), s["speaker"], F.lit("]"), s["text"]))
    return F.when(F.size(segments) == 0, "").otherwise(F.concat(F.array_join(body, ""), F.format_string("[%.2f]", F.element_at(segments, -1)["end"])))


def append_records(lines: DataFrame, good: str, rejected: str, checkpoint: str, every: dict | None = None):
    """Start a stream of manifest lines into a table of good records and one of rejected lines.

    Each batch replaces its own folder, so a batch that is run again after a loss adds nothing twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        rows = parsed(batch).persist()
        rows.where("good").drop("value", "good").write.mode("overwrite").parquet(f"{good}/batch={n}")
        rows.where("not good").select(F.col("value").alias("line")).write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        rows.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(every or {"availableNow": True})).start()


def gate_reports(gates: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """``(keys, value)``: one line of JSON for each run: its gates' values and the verdict.

    ``gates`` are ``(keys, gate, value, passed)``; the verdict is PASS if all of a run's gates
    have passed.  Gates stand in the order of their names; one without a value is left out.
    """
    named = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("gate", F.round("value", digits).alias("value")))))
    line = F.transform(named, lambda x: F.concat(_quoted(x["gate"]), F.lit(":"), x["value"].cast("string")))
    verdict = F.when(F.every(F.coalesce("passed", F.lit(False))), "PASS").otherwise("FAIL")
    by = gates.groupBy(*keys).agg(line.alias("_l"), verdict.alias("_v"))
    return by.select(*keys, F.concat(F.lit("{"), F.array_join(F.concat("_l", F.array(F.concat(F.lit('"verdict":"'), "_v", F.lit('"')))), ","), F.lit("}")).alias("value"))


def append_lines(lines: DataFrame, path: str) -> None:
    """Put lines (a ``value`` column) after those of the log that are there."""
    lines.select("value").write.mode("append").text(path)
