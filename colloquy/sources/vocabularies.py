"""Vocabularies of tokenizers as tables, and the tokens that structure is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What marks of time and speaker are spelt with, the glue of a JSON target, and what
# may stand before a key of it.
MARKS = [*"[]0123456789.", *(f"S{k:02d}" for k in range(1, 12))]
GLUE = ['"},{"', '"}]', '"},', "[{", '[{"', "}]"]
BEFORE_KEY = ["", "{", ",", ",{", '"},{', '"}],{']


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id, kind)`` of a tokenizer file: kind is ``special``, ``byte`` (as ``<0x0A>``) or ``plain``.

    Added tokens are special and count once, under their own ids.
    """
    text = spark.read.text(path, wholetext=True)
    model = F.from_json("value", "struct<model:struct<vocab:map<string,int>>,added_tokens:array<struct<id:int,content:string>>>")
    held = text.select(model.alias("m"))
    plain = held.select(F.explode("m.model.vocab").alias("token", "id"))
    added = held.select(F.inline("m.added_tokens")).select(F.col("content").alias("token"), "id").withColumn("special", F.lit(True))
    both = plain.join(added, ["token", "id"], "full")
    kind = F.when(F.col("special"), "special").when(F.col("token").rlike("^<0x[0-9A-Fa-f]{2}>$"), "byte").otherwise("plain")
    return both.select("token", "id", kind.alias("kind"))


def vocabulary_size(vocabulary: DataFrame) -> int:
    """One more than the greatest id; 0 without a token."""
    return (vocabulary.agg(F.max("id")).first()[0] + 1) if vocabulary.head(1) else 0


def encoded_ids(encode: Callable[[str], Iterable[int]], texts: Iterable[str]) -> set[int]:
    return {int(k) for t in texts for k in encode(t)}


def structural_ids(encode: Callable[[str], Iterable[int]]) -> set[int]:
    """Ids that marks of time and speaker are encoded to, each mark by itself."""
    return encoded_ids(encode, MARKS)


def target_glue_ids(encode: Callable[[str], Iterable[int]], keys: Iterable[str]) -> set[int]:
    """Ids of a JSON target's structure: its keys behind all that may stand before one, and its glue.

    Merged tokens depend on their neighbours, so every key is encoded in every place it can have.
    """
    return encoded_ids(encode, [f'{before}"{key}":' for key in keys for before in BEFORE_KEY]) | encoded_ids(encode, GLUE)
