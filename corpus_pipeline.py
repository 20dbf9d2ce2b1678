"""A training corpus from raw documents: five stages, each a table that the next one reads.

Every stage works on all that the one before kept and returns the columns of ``documents``,
but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import near_copies, packing, quality, suffix_dedup, toxicity
from colloquy.llm.common import stage, table

#: No SQL expresses the fitted model, the merged transforms or the packing plan.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below one half; texts without words and null texts stay,
    and repeated rows and rows without an id are judged like any other."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out())
    model = toxicity.fit(docs, labels)
    return docs.where(toxicity.score_column(model, F.col("text")) < 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio; null and empty texts fail,
    and repeated rows and rows without an id are judged like any other."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    return quality.quality_rules(rows, quality.trusted_ids(spark, sf_dir)).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash, then 5-word Jaccard 0.8) the document with the
    smallest id, once; of rows with one id the one with the least hash of its text.  Rows
    without an id stay."""
    first = near_copies.first_copies(docs)
    named = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").select(*docs.columns)
    own = F.struct("*")
    named = named.groupBy("doc_id").agg(F.min_by(own, F.xxhash64("text")).alias("row")).select("row.*")
    return named.unionByName(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has; n_chars follows the text."""
    rest = [c for c in docs.columns if c != "text"]
    got = suffix_dedup.suffix_dedup(docs, with_kept=True, carry=rest).select("rest.*", F.col("kept").alias("text"))
    if "n_chars" in rest:
        got = got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places; null texts are an end alone, repeated rows
    and rows without an id are packed each by itself."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash", drop_near_copies),
    ("suffix_dedup", drop_repeats),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
