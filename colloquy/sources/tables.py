"""Side tables: word files, voice lists, catalogs laid over each other, listings, recordings."""

from __future__ import annotations

import ast
import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def xml_words(spark: SparkSession, *paths: str) -> DataFrame:
    """Words of ``<meeting>.<speaker>.words.xml`` files: ``meeting, speaker, start, end, text``.

    Punctuation, words without a start and blank words are left out; a word without an end
    ends where it starts.  Order is by ``start`` wherever it matters, never by row.
    """
    kinds = "_starttime double, _endtime double, _punc boolean, _VALUE string"
    w = spark.read.format("xml").option("rowTag", "w").schema(kinds).load(list(paths))
    name = F.split(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.")
    kept = w.where("_starttime is not null and not coalesce(_punc, false) and trim(_VALUE) != ''")
    return kept.select(
        F.get(name, F.lit(0)).alias("meeting"), F.get(name, F.lit(1)).alias("speaker"),
        F.col("_starttime").alias("start"), F.coalesce("_endtime", "_starttime").alias("end"), F.trim("_VALUE").alias("text"),
    )


def turns(words: DataFrame, offset: float, duration: float, gap: float = 1.0) -> DataFrame:
    """Words of a slice as turns: one speaker's words up to ``gap`` s apart, times from the slice's start.

    ``label`` numbers a meeting's speakers by first appearance.
    """
    cut = words.where((F.col("start") >= offset) & (F.col("start") < offset + duration))
    one = Window.partitionBy("meeting", "speaker").orderBy("start", "end", "text")
    latest = F.max("end").over(one.rowsBetween(Window.unboundedPreceding, -1))
    opened = cut.withColumn("_new", F.when(latest.isNull() | (F.col("start") - latest > gap), 1).otherwise(0))
    island = opened.withColumn("_island", F.sum("_new").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_sort(F.collect_list(F.struct("start", "end", "text")))
    merged = island.groupBy("meeting", "speaker", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(said, lambda x: x["text"]), " ").alias("text")
    )
    first = merged.groupBy("meeting", "speaker").agg(F.min("start").alias("_first"))
    label = F.row_number().over(Window.partitionBy("meeting").orderBy("_first", "speaker"))
    named = first.select("meeting", "speaker", F.format_string("S%02d", label).alias("label"))
    return merged.join(named, ["meeting", "speaker"]).select(
        "meeting", "speaker", "label", (F.col("start") - offset).alias("start"), (F.least("end", F.lit(offset + duration)) - offset).alias("end"), "text"
    )


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, name, length`` of the non-empty files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.where("length > 0").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def voices(spark: SparkSession, tsv: str, clips: DataFrame, least: int) -> DataFrame:
    """Clients of a tab-separated list with ``least`` or more clips on disk: ``client_id, paths``."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(tsv)
    named = rows.select("client_id", F.element_at(F.split("path", "/"), -1).alias("name"))
    found = named.join(clips.select("name", "path"), "name").groupBy("client_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return found.where(F.size("paths") >= least)


def overlaid(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the values of ``over`` first wherever they are not null."""
    other = [c for c in dict.fromkeys([*base.columns, *over.columns]) if c != key]
    pick = lambda c: [F.col(f"{s}.{c}") for s, t in (("o", over), ("b", base)) if c in t.columns]
    return base.alias("b").join(over.alias("o"), key, "full_outer").select(key, *[F.coalesce(*pick(c)).alias(c) for c in other])


def loose_dict(text: Column) -> Column:
    """A printed Python dictionary as a map of texts; what is none gives null."""

    @F.pandas_udf("map<string,string>")
    def read(texts):
        def one(t):
            try:
                got = ast.literal_eval(t)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                return None
            return {str(k): None if v is None else str(v) for k, v in got.items()} if isinstance(got, dict) else None

        return texts.map(one)

    return read(text)


def wav_levels(content: Column, first_s: Column | float = 0.0, seconds: Column | float = 1e9) -> Column:
    """``rate, frames, peak, rms`` of a slice of 16-bit wav bytes, channels averaged; null if unreadable."""
    kind = "struct<rate:int,frames:bigint,peak:double,rms:double>"

    @F.pandas_udf(kind)
    def read(data, first, length):
        out = []
        for raw, a, n in zip(data, first, length, strict=True):
            try:
                with wave.open(io.BytesIO(raw)) as w:
                    rate, total = w.getframerate(), w.getnframes()
                    at = min(max(int(a * rate), 0), total)
                    w.setpos(at)
                    x = np.frombuffer(w.readframes(max(min(int(n * rate), total - at), 0)), "<i2").reshape(-1, w.getnchannels())
            except (wave.Error, EOFError, TypeError, ValueError):
                out.append((None, None, None, None))
                continue
            x = x.mean(axis=1) / 32768.0
            out.append((rate, len(x), float(np.abs(x).max()) if len(x) else 0.0, float(np.sqrt((x * x).mean())) if len(x) else 0.0))
        return pd.DataFrame(out, columns=["rate", "frames", "peak", "rms"]).astype({"rate": "Int32", "frames": "Int64"})

    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return read(content, as_column(first_s), as_column(seconds))
