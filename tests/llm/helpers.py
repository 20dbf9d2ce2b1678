"""Small inputs with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random
import sys

from pyspark.sql import functions as F

CLASH = ["_words", "_id", "_t", "_own", "_text", "_score", "t", "fp", "kept", "rest", "piece", "rank", "count", "block", "llr", "node", "train"]

WORDS = "the river ran under old stone bridges while people watched boats carry grain toward distant towns and markets near hills".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def edge_rows():
    shared = prose(99, 40)
    rows = [(1, prose(1, 80)), (2, None), (3, ""), (4, "   \n\t "), (5, prose(1, 80)), (6, "one"), (7, "two words")]
    rows += [(8, prose(2, 30) + " " + shared + " " + prose(3, 30)), (9, shared), (10, "x" * 300 + shared), (11, "é" * 200 + "\n" + "é" * 120)]
    rows += [(12, "a b c " * 60), (13, prose(4, 30_000)), (14, prose(1, 79) + " changed"), (None, prose(1, 80)), (15, None), (12, "a b c " * 60)]
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in CLASH if clash else ():
        df = df.withColumn(c, F.lit("other"))
    return df


def empty(spark):
    return frame(spark, [])
