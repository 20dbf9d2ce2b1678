import math

import numpy as np
from colloquy.llm import toxicity as tx
from pyspark.sql import functions as F

from tests.llm.helpers import edge_rows, empty, frame, prose


def labelled(spark, n=160):
    rows = []
    for k in range(n):
        sents = [prose(5000 + 10 * k + j, 9).capitalize() + "." for j in range(5)]
        if k % 2:
            sents[k % 5] = "You vilefoo grumbly snarkbar."
        rows.append((k, " ".join(sents)))
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)] + [(3, 1), (None, 1), (500, None)], "doc_id long, toxic int")
    return rows, labels


def test_learns_from_documents_and_finds_the_sentence(spark):
    rows, labels = labelled(spark)
    docs = frame(spark, [*rows, *[(1000 + (i or 0), t) for i, t in edge_rows()]])
    model = tx.fit(docs, labels.where("doc_id < 120 or doc_id is null"))
    got = {r.doc_id: r for r in docs.select("doc_id", tx.score_column(model, F.col("text")).alias("s"), tx.judged(model, F.col("text")).alias("j")).select("doc_id", "s", "j.score", F.col("j.offending").alias("o")).collect()}
    for k in range(120, 160):
        assert (got[k].s >= 0.5) == bool(k % 2) and got[k].score == got[k].s
        assert [x.sentence for x in got[k].o] == ([k % 5] if k % 2 else [])
    for i, _ in edge_rows():
        assert got[1000 + (i or 0)].s < 0.5 and not math.isnan(got[1000 + (i or 0)].s)


def test_score_is_noisy_or_of_the_sentences():
    model = tx.Model({"bad": 5.0, "worse": 6.0}, -6.0)
    logits, _ = model.sentence_logits("bad day here. worse day.\nfine")
    p = 1 / (1 + np.exp(-logits))
    assert np.allclose(model.score("bad day here. worse day.\nfine"), 1 - np.prod(1 - p))
    assert model.score(None) == model.score("") == model.score(" \n") == 0.0


def test_gradient_is_that_of_the_loss():
    bags, slot = tx.Bags(), {"bad": 0, "worse": 1, "fine": 2}
    for text, y in (("bad day. fine day. plain.", 1), ("fine. fine bad.\nplain", 0), ("worse bad. worse.", 1), ("", 0), (None, 1), ("plain. plain", 0)):
        bags.add(text, y, slot)
    sample = bags.arrays()
    w = np.array([0.7, -0.4, 0.2, -1.1])
    loss, g = tx.loss_and_gradient(w, *sample)

    def by_hand(w):
        """The loss from the definition, document by document."""
        total, n = 0.0, {1: 3, 0: 3}
        texts = [([[0], [2], []], 1), ([[2], [0, 2], []], 0), ([[0, 1], [1]], 1), ([], 0), ([], 1), ([[], []], 0)]
        for sents, y in texts:
            clean = np.prod([1 - 1 / (1 + math.exp(-(sum(w[f] for f in s) + w[3]))) for s in sents])
            total -= 0.5 / n[y] * math.log(max(1 - clean, 1e-9) if y else clean)
        return total + 2e-4 / 3 * (w[:3] ** 2).sum() / 2

    assert abs(loss - by_hand(w)) < 1e-9
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        assert abs((by_hand(w + step) - by_hand(w - step)) / 2e-5 - g[k]) < 1e-6


def test_features_are_screened_by_document_frequency(spark):
    docs = [("bad bad fine", 1)] * 6 + [("fine plain", 0)] * 6 + [("rare bad", 1)] * 3
    sample = spark.createDataFrame(docs, "t string, y int")
    z = lambda p, n: abs(p / 9 - n / 6) / math.sqrt((p + n) / 15 * (1 - (p + n) / 15) * (1 / 9 + 1 / 6)) if p + n < 15 else 0.0
    want = {f for f, p, n in (("bad", 9, 0), ("plain", 0, 6), ("^plai", 0, 6), ("^plain", 0, 6), ("fine", 6, 6), ("^fine", 6, 6)) if z(p, n) > tx.LEAST_Z}
    assert set(tx.screened(sample, 6, 9)) == want and "bad" in want


def test_one_label_or_none(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    for y, want in ((None, 0.0), (0, 0.0), (1, 1.0)):
        labels = spark.createDataFrame([(1, y)] if y is not None else [], "doc_id long, toxic int")
        score = docs.where("doc_id = 1").select(tx.score_column(tx.fit(docs, labels), F.col("text"))).first()[0]
        assert abs(score - want) < 1e-6
    assert empty(spark).select(tx.score_column(tx.Model({}, -20.0), F.col("text"))).count() == 0


def test_held_out_accuracy_on_the_tables(spark, sf_dir):
    # sf0.01 has 45 toxic labels to learn from, too few: 65 of its 70 held-out rows come out right
    d = sf_dir.replace("sf0.001", "sf0.1")
    out = tx.op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((r.predicted == 1) == (r.score >= 0.5) and (not r.offending or r.score >= 0.5) for r in out)
    hit = sum(r.predicted == r.toxic for r in out)
    assert hit >= 0.95 * len(out)
