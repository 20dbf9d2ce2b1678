"""Toxicity by multiple-instance learning: sentences are instances, documents are bags.

Only documents carry labels.  A sentence has probability ``sigmoid(bias + sum of weights)``;
a document is toxic if any sentence is (noisy-or): ``p = 1 - prod(1 - p_sentence)``.  The
weights are fitted to the document labels through that formula, after which the sentence
probabilities locate what offends.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_stage, stage, table

#: Bounds of the labelled sample the model is fitted to: rows of either label, whole texts of
#: so many bytes at most, and bytes in all of either label.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 8000
SAMPLE_TEXT_BYTES, SAMPLE_BYTES = 1 << 20, 32 << 20
#: Features kept after screening, at most; rarer ones and those with a smaller z are left out.
MAX_FEATURES, LEAST_DOCS, LEAST_Z = 20_000, 4, 3.5
_EDGE = ".,;:!?\"'()[]{}<>|#*$%&-_/\\«»…0123456789"


def _features(word: str) -> list[str]:
    """The word's own form and its first five, four letters."""
    core = word.strip(_EDGE).lower()
    if not core:
        return []
    out = [core]
    if len(core) >= 4:
        out.append("^" + core[:4])
    if len(core) >= 5:
        out.append("^" + core[:5])
    return out


def _ends(word: str) -> bool:
    return word[-1] in ".!?…" or (len(word) > 1 and word[-1] in "\"')»" and word[-2] in ".!?…")


def sentences(text: str) -> list[list[str]]:
    """Words by sentence: a line break or a word that ends with a full stop ends one."""
    out = []
    for line in text.split("\n"):
        held = []
        for w in line.split():
            held.append(w)
            if _ends(w):
                out.append(held)
                held = []
        if held:
            out.append(held)
    return out


def _document_features(text: str | None) -> set[str]:
    """Distinct features of a whole text."""
    return {f for w in set((text or "").split()) for f in _features(w)}


class Bags:
    """A sample as flat arrays: feature ids by sentence, sentences by document, labels.

    Sentences without a kept feature all have the bias alone as their logit, so a document
    holds only how many it has.
    """

    def __init__(self):
        self.feat, self.n_feat, self.n_sent = array("i"), array("i"), array("i")
        self.bare, self.y = array("i"), array("b")

    def add(self, text: str | None, y: int, slot: dict[str, int]) -> None:
        full = bare = 0
        for words in sentences(text or ""):
            found = sorted({slot[f] for w in words for f in _features(w) if f in slot})
            if found:
                self.feat.extend(found)
                self.n_feat.append(len(found))
                full += 1
            else:
                bare += 1
        self.n_sent.append(full)
        self.bare.append(bare)
        self.y.append(y)

    def arrays(self) -> tuple[np.ndarray, ...]:
        n_feat, n_sent = np.array(self.n_feat, np.int32), np.array(self.n_sent, np.int32)
        sent = np.repeat(np.arange(len(n_feat), dtype=np.int32), n_feat)
        bags = np.repeat(np.arange(len(n_sent), dtype=np.int32), n_sent)
        return np.array(self.feat, np.int32), sent, bags, np.array(self.bare, np.float64), np.array(self.y, np.float64)


def loss_and_gradient(w: np.ndarray, feat, sent, bags, bare, y, l2: float = 2e-4) -> tuple[float, np.ndarray]:
    """Class-balanced noisy-or loss and its gradient; the last weight is the bias.

    Document j with sentence logits s has log P(clean) = -sum log(1 + exp s); the loss is
    minus the mean log likelihood of either label, halved, and ``l2`` over the weights.
    """
    n_sent, n_docs, n_feat = len(bags), len(y), len(w) - 1
    s = np.bincount(sent, w[feat], n_sent) + w[-1]
    clear = -np.bincount(bags, np.logaddexp(0, s), n_docs) - bare * np.logaddexp(0, w[-1])
    none = np.exp(clear)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    loss = -(weight * np.where(y == 1, np.log(np.maximum(-np.expm1(clear), 1e-9)), clear)).sum()
    # d loss / d s: p on clean documents, -p * none / (1 - none) on toxic ones
    by_bag = np.where(y == 1, -none / np.maximum(-np.expm1(clear), 1e-9), 1.0) * weight
    p, p_bare = (1 / (1 + np.exp(-np.clip(x, -40, 40))) for x in (s, w[-1]))
    g_s = by_bag[bags] * p
    g = np.append(np.bincount(feat, g_s[sent], n_feat), g_s.sum() + (by_bag * bare).sum() * p_bare)
    ridge = l2 / max(n_feat, 1)
    return float(loss + ridge * (w[:-1] ** 2).sum() / 2), g + ridge * np.append(w[:-1], 0)


def fit_weights(n_feat: int, sample: tuple[np.ndarray, ...], rounds: int = 400, rate: float = 0.15) -> np.ndarray:
    """Weights and bias by full-batch Adam on the noisy-or likelihood."""
    w = np.zeros(n_feat + 1)
    w[-1] = -6.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        _, g = loss_and_gradient(w, *sample)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def noisy_or(logits: np.ndarray) -> float:
    """Probability that any sentence is toxic; no sentence: 0."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


_JUDGED = "score double, offending array<struct<sentence:int, first_word:int, n_words:int, p:double>>"


class Model:
    """Feature weights and a bias; at most ``MAX_FEATURES`` entries, so it travels by closure."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self._seen: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_seen": {}}

    def word(self, word: str) -> float:
        got = self._seen.get(word)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in _features(word))
            if len(self._seen) < 400_000:
                self._seen[word] = got
        return got

    def sentence_logits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each sentence and the number of words in it."""
        words, cuts = [], []
        for line in text.split("\n"):
            own = line.split()
            if own:
                words += own
                cuts.append(len(words) - 1)
        n = len(words)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64)
        get = self._seen.get
        w = np.array([get(x) if x in self._seen else self.word(x) for x in words])
        last = np.fromiter((x[-1] in ".!?…" or _ends(x) for x in words), bool, n)
        last[cuts] = True
        ends = np.flatnonzero(last)
        starts = np.append(0, ends[:-1] + 1)
        return np.add.reduceat(w, starts) + self.bias, ends - starts + 1

    def score(self, text: str | None) -> float:
        return noisy_or(self.sentence_logits(text or "")[0])


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic: int, clean: int) -> DataFrame:
    """``(t, y, k)``: the texts to learn from, chosen by a hash of their ids, within the bounds."""
    own = labels.where("toxic in (0, 1)").groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("y"))
    own = own.where("_id is not null")
    order = [F.xxhash64("_id"), F.col("_id")]
    ids = own.where("y = 1").orderBy(*order).limit(toxic).union(own.where("y = 0").orderBy(*order).limit(clean))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.where(F.octet_length("t") <= SAMPLE_TEXT_BYTES).join(F.broadcast(ids), "_id")
    rows = stage(rows.select("_id", "t", "y", F.xxhash64("_id").alias("k"), F.octet_length("t").alias("n")), "toxicity-sample")
    # ids, labels and sizes of the bounded sample alone go through one window a label
    upto = Window.partitionBy("y").orderBy("k", "_id", "n").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.select("_id", "y", "k", "n").withColumn("upto", F.sum("n").over(upto)).groupBy("_id").agg(F.max("upto").alias("upto"))
    out = rows.join(F.broadcast(sizes.where(F.col("upto") <= SAMPLE_BYTES).select("_id")), "_id").select("t", "y", "k", "_id")
    out._colloquy_path = rows._colloquy_path
    return out


def screened(sample: DataFrame, n_clean: int, n_toxic: int) -> list[str]:
    """Features whose shares of toxic and of clean documents differ clearly, clearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                for f in _document_features(t.as_py()):
                    seen.setdefault(f, [0, 0])[y] += 1
        names = pa.array(list(seen), pa.string())
        yield pa.RecordBatch.from_arrays([names, *(pa.array([c[y] for c in seen.values()], pa.int64()) for y in (0, 1))], ["feature", "clean", "toxic"])

    counts = sample.select("t", "y").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n_clean + n_toxic))
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * F.lit(1 / n_toxic + 1 / n_clean))
    z = F.abs((F.col("toxic") / F.lit(float(n_toxic)) - F.col("clean") / F.lit(float(n_clean))) / spread)
    kept = counts.where(F.col("clean") + F.col("toxic") >= LEAST_DOCS).select("feature", z.alias("z")).where(F.col("z") > LEAST_Z)
    return [r.feature for r in kept.orderBy(F.col("z").desc(), "feature").limit(MAX_FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Fit to a bounded sample of labelled rows, chosen by a hash of their ids.

    Features are counted and screened in Spark; one task fits the weights over the sample's
    ids of kept features, so what it holds follows ``SAMPLE_BYTES`` and not the table.  Rows
    with a null id or label are not learnt from; a repeated label row counts once, and ties
    of the hash go by id.  With one label only (or none) the model gives every document that
    label's score.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, toxic, clean)
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    names = screened(sample, n[0], n[1]) if len(n) == 2 else []
    if not names:
        drop_stage(sample)
        return Model({}, 20.0 if list(n) == [1] else -20.0)
    slot = {f: k for k, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = Bags()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                bags.add(t.as_py(), y, slot)
        got = fit_weights(len(slot), bags.arrays()) if len(bags.y) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(got))), pa.array(got)], ["k", "w"])

    rows = sample.repartition(1).sortWithinPartitions("k", "_id", "t").select("t", "y").mapInArrow(run, "k long, w double").orderBy("k").collect()
    drop_stage(sample)
    return Model({f: rows[k].w for f, k in slot.items()}, rows[-1].w)


def score_column(model: Model, text: Column) -> Column:
    """The noisy-or score of each text, 0 to 1; null and empty texts: 0."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return score(text)


def spans(logits: np.ndarray, n_words: np.ndarray, least: float) -> list[dict]:
    """Sentences with probability ``least`` or more: their number, first word, words and p."""
    p, first = 1 / (1 + np.exp(-np.clip(logits, -40, 40))), np.cumsum(n_words) - n_words
    return [{"sentence": int(k), "first_word": int(first[k]), "n_words": int(n_words[k]), "p": float(p[k])} for k in np.flatnonzero(p >= least)]


def judged(model: Model, text: Column, least: float = 0.5) -> Column:
    """``struct(score, offending)`` of each text in one pass: the noisy-or score, and the
    sentences with probability ``least`` or more.  Null and empty texts: 0 and none; repeated
    and long texts are judged whole, each by itself."""
    kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("sentence", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32()), ("p", pa.float64())])))])

    @F.arrow_udf(_JUDGED)
    def judge(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            s, n = model.sentence_logits(t.as_py() or "")
            out.append({"score": noisy_or(s), "offending": spans(s, n, least)})
        return pa.array(out, kind)

    return judge(text)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, score, predicted, offending)`` of every document.

    Learnt from the labelled rows of the other four folds.  Null and empty texts score 0;
    repeated rows stay repeated and score alike; a null id is never held out; other columns
    of the table are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    out = docs.select("doc_id", held_out().alias("held_out"), judged(fit(docs, labels), F.col("text")).alias("j"))
    return out.select("doc_id", "held_out", "j.score", (F.col("j.score") >= 0.5).cast("int").alias("predicted"), "j.offending")
