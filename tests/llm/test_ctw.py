import math
import re
import zlib

import numpy as np
import pytest
from colloquy.llm import ctw
from pyspark.sql import functions as F

from tests.llm.helpers import edge_rows, empty, frame, prose


def tokens(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), ""]


def slow_costs(texts, train):
    """Bits of each text by the recursive definition of context-tree weighting, bit by bit."""
    seen = {}

    def steps(t):
        raw = bytes([ctw.BEFORE]) * ctw.DEPTH + t + bytes([ctw.END])
        for k in range(ctw.DEPTH, len(raw)):
            yield tuple(raw[k - 1 - j] for j in range(ctw.DEPTH)), raw[k]

    for t in train:
        for ctx, byte in steps(t):
            for d in range(ctw.DEPTH + 1):
                node = 1
                for level in range(7, -1, -1):
                    bit = byte >> level & 1
                    seen.setdefault((ctx[:d], node), [0, 0])[bit] += 1
                    node = 2 * node + bit
    children = {}
    for ctx, node in seen:
        if ctx:
            children.setdefault((ctx[:-1], node), []).append(ctx)

    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_w(ctx, node):
        e = kt(*seen[ctx, node])
        if len(ctx) == ctw.DEPTH:
            return e, 1.0
        below = sum(log_w(c, node)[0] for c in children.get((ctx, node), []))
        return np.logaddexp(e, below) - math.log(2), 1 / (1 + math.exp(min(700, below - e)))

    def p_one(ctx, node, d=0):
        own = seen.get((ctx[:d], node))
        if own is None:
            return 0.5
        est = (own[1] + 0.5) / (sum(own) + 1)
        if d == ctw.DEPTH:
            return est
        stay = log_w(ctx[:d], node)[1]
        return stay * est + (1 - stay) * p_one(ctx, node, d + 1)

    out = []
    for t in texts:
        bits = 0.0
        for ctx, byte in steps(t):
            node = 1
            for level in range(7, -1, -1):
                bit = byte >> level & 1
                p = p_one(ctx, node)
                bits -= math.log2(p if bit else 1 - p)
                node = 2 * node + bit
        out.append(bits)
    return out


def test_scores_agree_with_the_definition(spark):
    train = ["the cat sat on the mat", "the hat", "", "a cat and a hat", "été 日本", "THE"]
    others = ["the cat", "zebra #1", None, "日本 été", "\n\n"]
    rows = [(k, t) for k, t in enumerate(train + others)]
    out = {r.doc_id: r for r in ctw.score_documents(frame(spark, rows), F.col("doc_id") < len(train)).collect()}
    want = slow_costs([(t or "").encode() for _, t in rows], [t.encode() for t in train])
    for (k, t), bits in zip(rows, want, strict=True):
        assert -out[k].score / math.log10(2) == pytest.approx(bits, abs=0.01 + 0.002 * (len((t or "").encode()) + 1))


def test_base_score_agrees_with_brute_force(spark):
    rows = [*edge_rows(), (50, "The RIVER é É end"), (51, "unknownword the")]
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    c = {}
    for i, t in rows:
        for w in tokens(t) if learns(i) else ():
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(tokens(t))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    out = ctw.score_documents(frame(spark, rows), crc).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.train == learns(r.doc_id) and r.train_tokens == n
        assert any(
            r.n_tokens == len(t) and r.n_known == sum(w in c for w in t)
            and r.base_score == pytest.approx(sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
            for t in by[r.doc_id]
        )
        assert r.score < 0 and math.isfinite(r.score)


def test_nothing_to_learn_from(spark):
    r = ctw.score_documents(frame(spark, [(1, "abc")]), F.lit(False)).first()
    assert r.score == pytest.approx(-4 * 8 * math.log10(2), rel=1e-3) and r.n_known == 0
    assert ctw.score_documents(empty(spark), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_keys_are_contexts_in_bucket_order(n):
    raw = np.random.default_rng(n).integers(0, 256, n + ctw.DEPTH).astype(np.uint8)
    keys = ctw.routed_key(raw)
    assert len(set(zip(*[raw[k : len(raw) - ctw.DEPTH + k].tolist() for k in range(ctw.DEPTH + 1)], strict=True))) == len(np.unique(keys))
    assert (ctw.last_byte(keys) == raw[ctw.DEPTH - 1 : -1]).all() and ((keys & np.uint64(255)) == raw[ctw.DEPTH :]).all()
    assert (np.diff(ctw.bucket_of(np.sort(keys))) >= 0).all()
    assert (ctw.keys_of(ctw.packed(np.diff(np.sort(keys), prepend=np.uint64(0)))) == np.sort(keys)).all()


def test_the_query_itself(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = ctw.op9_ctw(spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    c = {}
    for r in docs:
        for w in tokens(r.text) if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 else ():
            c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for r in docs:
        t, g = tokens(r.text), got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) and g.train_tokens == n
        assert (g.n_tokens, g.n_known) == (len(t), sum(w in c for w in t))
        assert g.base_score == pytest.approx(sum(math.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel=1e-9)
    size = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs}
    held, learnt = ([g for g in got.values() if g.held_out == h and g.n_tokens > 50] for h in (True, False))
    per_byte = lambda rows: -sum(g.score for g in rows) / math.log10(2) / sum(size[g.doc_id] for g in rows)
    assert per_byte(learnt) < per_byte(held) < 4


def test_seen_text_is_cheaper_than_unseen(spark):
    rows = [(k, prose(k, 200)) for k in range(30)] + [(99, "".join(chr(33 + k * 7 % 90) for k in range(1000)))]
    out = {r.doc_id: r for r in ctw.score_documents(frame(spark, rows), F.col("doc_id") < 20).collect()}
    per_byte = lambda k: -out[k].score / len(rows[min(k, 30)][1])
    assert max(per_byte(k) for k in range(30)) < per_byte(99) / 2
