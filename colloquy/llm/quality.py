"""Quality rules in DataFrame functions only: base counts and a hashed n-gram likelihood ratio.

The ratio compares two multinomials over hashed word n-grams: one of a trusted target, one of
the raw corpus.  A document's score is the sum of its n-grams' log ratios divided by their
number, so length does not matter, and every document meets one fixed threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import table

#: Buckets of the two multinomials; the ratio table is one array of so many doubles.
BUCKETS = 16_384
#: At most so many trusted rows stand for the target; the raw counts cover every row.
TARGET_ROWS = 20_000
#: Kept where the mean log ratio (nats an n-gram) is at least this.
THRESHOLD = -0.04
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACE = "[ \\t\\n\\u000B\\f\\r]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _after(hashes: Column, k: int) -> Column:
    """All but the first ``k`` hashes."""
    return F.slice(hashes, k + 1, F.greatest(F.size(hashes) - k, F.lit(0)))


def grams_of(hashes: Column, buckets: int = BUCKETS) -> tuple[Column, Column]:
    """Buckets of the words and of the pairs of neighbouring words, from the words' hashes."""
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.transform(_after(hashes, 1), lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(buckets)).cast("int"))
    return one, two


def with_base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``_hashes`` (of the words) and the base counts to every row.

    n_words, word_chars (code points in words), n_symbols (``[#*$%&|<>]``), n_dup_lines
    (lines with a word, equal to an earlier line), n_repeat_words (words inside 3-word
    windows that occur twice or more in the text).  Null or empty text: all zero.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    d = docs.withColumn("_words", words_of(F.col(text_col))).withColumn("_lines", lines)
    d = d.withColumn("_hashes", hashes_of(F.col("_words")))
    h = F.col("_hashes")
    d = d.withColumn("_windows", F.transform(_after(h, 2), lambda x, i: F.xxhash64(F.get(h, i), F.get(h, i + 1), x)))
    w = F.col("_windows")
    # windows are put in order only where one occurs again, which few texts have
    some = F.size(F.array_distinct(w)) < F.size(w)
    numbered = F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    d = d.withColumn("_placed", F.sort_array(F.when(some, numbered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))))
    s = F.col("_placed")
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    again = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
    d = d.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    a = F.col("_again")
    covered = F.aggregate(
        F.transform(a, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda t, x: t + x,
    )
    return d.withColumns(
        {
            "n_words": F.size(h).cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("_words", "_lines", "_windows", "_placed", "_again")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def ratio_table(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, target_rows: int) -> Column:
    """The log ratio of each bucket as one constant array.

    The array passes through the driver once, ``buckets`` doubles whatever the corpus, and so
    does not travel in the rows.  ``trusted`` holds the ids of trusted documents; ``target_rows`` of them at most, chosen by
    a hash of the id, make the target.  Both multinomials are smoothed by one n-gram a bucket.
    """
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(target_rows).withColumn("_target", F.lit(1))
    seen = (
        docs.select(F.col(id_col).alias("_id"), hashes_of(words_of(F.col(text_col))).alias("_hashes"))
        .join(F.broadcast(ids), "_id", "left")
        .select(F.explode(F.concat(*grams_of(F.col("_hashes"), buckets))).alias("b"), F.coalesce("_target", F.lit(0)).alias("t"))
        .groupBy("b")
        .agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    )
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("b")).join(seen, "b", "left").na.fill(0)
    whole = every.agg(
        F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("x"),
        F.sum("raw").alias("r"),
        F.sum("target").alias("t"),
    )
    b = float(buckets)
    llr = lambda x: (
        F.log((x["target"] + 1.0) / (F.col("t") + b)) - F.log((x["raw"] + 1.0) / (F.col("r") + b))
    )
    table = whole.select(F.transform("x", llr).alias("llr")).first().llr
    return F.split(F.lit(" ".join(map(repr, table))), " ").cast("array<double>")


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    target_rows: int = TARGET_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every row of ``docs`` with the base counts, ``llr``, ``base_failed`` and ``kept``.

    Rows are judged one by one after one corpus pass for the two multinomials; repeated rows
    stay repeated, and rows with a null id are judged like any other.  No trusted row: the
    target is flat.  A text without words has llr 0 and fails the base rules.  Other columns
    stay as they are, but one named like a result gives way to it.
    """
    llr = ratio_table(docs, trusted, id_col, text_col, buckets, target_rows)
    d = docs.select(F.struct("*").alias("_own"), F.col(text_col).alias("_text"))
    d = with_base_counts(d, "_text")
    one, two = grams_of(F.col("_hashes"), buckets)
    sums = [F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(llr, b)) for g in (one, two)]
    d = d.withColumn("llr", F.when(F.col("n_words") > 0, (sums[0] + sums[1]) / (2 * F.col("n_words") - 1)).otherwise(0.0)).drop("_hashes")
    d = d.withColumn("base_failed", base_failed())
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    # generated from one struct, the verdicts are computed once: a caller's filter on them
    # would otherwise be rewritten into the whole chain of expressions, over and over
    found = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    own = [F.col("_own")[c].alias(c) for c in docs.columns if c.lower() not in found]
    return d.select(*own, F.inline(F.array(F.struct(*found))))


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, llr)`` of every document; nulls, empty, long and repeated texts as in
    ``quality_rules``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, trusted_ids(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )
