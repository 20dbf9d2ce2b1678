"""Scores of a timed transcript against words: text, onsets, speakers and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.edits import aligned
from colloquy.operators.metrics import speaker_errors


def four_axes(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """One row a recording of the reference; both sides are ``(key, start, pos, speaker, token)``.

    ``wer`` over reference tokens; ``onset_median`` and ``onset_p90`` of tokens that are the
    same on both sides (sorted places n // 2 and floor(0.9 n)), shares ``within_1s``, ``within_2s``
    and ``within_5s`` of them; ``ref_span`` and ``hyp_span``, first to last token's start;
    ``words_a_segment`` of the hypothesis, whose tokens of one segment share ``start`` and speaker;
    ``speaker_accuracy``: the share of same tokens whose speaker is the one that most same
    tokens of their label have.  A recording's tokens are one row; without any same token the
    onsets and the accuracy are null.
    """

    def stream(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "pos", "speaker", "token"))).alias(name))

    words = lambda c: F.transform(c, lambda x: x["token"])
    none = F.expr("filter(r, x -> false)")
    both = stream(ref, "r").join(stream(hyp, "h"), key, "left").withColumn("h", F.coalesce("h", none))
    pairs = both.select(key, F.size("r").alias("n_ref"), "r", "h", F.explode(aligned(words("r"), words("h"))).alias("p"))
    pairs = pairs.select(key, "n_ref", F.get("r", "p.i").alias("x"), F.get("h", "p.j").alias("y"))
    same = F.coalesce(F.col("x.token") == F.col("y.token"), F.lit(False))
    pairs = pairs.select(key, "n_ref", "x", "y", same.alias("same"), F.abs(F.col("x.start") - F.col("y.start")).alias("gap"))
    counts = pairs.groupBy(key).agg(
        F.first("n_ref").cast("long").alias("n_ref"),
        F.count_if(~F.col("same")).alias("errors"),
        F.count_if("same").alias("matched"),
        F.count_if(F.col("y").isNull()).alias("deletions"),
        F.count_if(F.col("x").isNull()).alias("insertions"),
    )
    hit = pairs.where("same").withColumns({
        "place": F.row_number().over(Window.partitionBy(key).orderBy("gap")) - 1,
        "n": F.count("*").over(Window.partitionBy(key)),
    })
    onset = hit.groupBy(key).agg(
        F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("gap"))).alias("onset_median"),
        F.max(F.when(F.col("place") == F.floor(F.col("n") * 9 / 10), F.col("gap"))).alias("onset_p90"),
        *(F.avg(F.when(F.col("gap") <= 1000 * t, 1.0).otherwise(0.0)).alias(f"within_{t}s") for t in (1, 2, 5)),
    )
    votes = hit.groupBy(key, F.col("y.speaker").alias("label"), F.col("x.speaker").alias("who")).agg(F.count("*").alias("votes"))
    pure = votes.groupBy(key, "label").agg(F.max("votes").alias("most"), F.sum("votes").alias("all"))
    pure = pure.groupBy(key).agg((F.sum("most") / F.sum("all")).alias("speaker_accuracy"))
    out = counts.join(onset, key, "left").join(pure, key, "left")
    span = lambda rows, name: rows.groupBy(key).agg(F.struct(F.min("start").alias("first"), F.max("start").alias("last")).alias(name))
    dense = hyp.groupBy(key).agg((F.count("*") / F.count_distinct("start", "speaker")).alias("words_a_segment"))
    out = out.join(span(ref, "ref_span"), key, "left").join(span(hyp, "hyp_span"), key, "left").join(dense, key, "left")
    return out.withColumn("wer", F.col("errors") / F.greatest("n_ref", F.lit(1)))


def speaker_score(ref: DataFrame, hyp: DataFrame, key: str) -> DataFrame:
    """``(key, ref_speakers, hyp_speakers, consistency, der)`` of each reference recording, to three digits."""
    n = lambda rows, name: rows.groupBy(key).agg(F.count_distinct("speaker").alias(name))
    e = speaker_errors(ref, hyp, key).select(key, F.round("consistency", 3).alias("consistency"), F.round("der", 3).alias("der"))
    out = n(ref, "ref_speakers").join(n(hyp, "hyp_speakers"), key, "left").join(e, key)
    return out.select(key, "ref_speakers", F.coalesce("hyp_speakers", F.lit(0)).alias("hyp_speakers"), "consistency", "der")
