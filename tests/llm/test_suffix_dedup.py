import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from colloquy.llm import bwt
from colloquy.llm import suffix_dedup as sd

from tests.llm.helpers import edge_rows, empty, frame, prose


def brute(rows, width=50):
    least = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, t in raw:
        if i is not None:
            for k in range(len(t) - width + 1):
                w = t[k : k + width]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1 if i is not None else 0):
            if least[t[k : k + width]] < i:
                gone[k : k + width] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_agrees_with_brute_force(spark):
    rows = edge_rows()
    assert got(sd.suffix_dedup(frame(spark, rows))) == brute(rows)


def test_many_shared_passages(spark):
    passages = [prose(k, 15) for k in range(12)]
    rows = [(k, " ".join([prose(1000 + k, 12), passages[k % 12], prose(2000 + k, 5), passages[(k * 7) % 12][20:]])) for k in range(120)]
    assert got(sd.suffix_dedup(frame(spark, rows))) == brute(rows)


def test_a_line_with_different_surroundings_fills_no_bucket(spark):
    line = prose(7, 8)[:64]
    rows = [(k, f"{hashlib.md5(b'%d' % k).hexdigest()} {line} {hashlib.md5(b'-%d' % k).hexdigest()}") for k in range(12_000)]
    docs = frame(spark, rows, clash=False)
    assert got(sd.suffix_dedup(docs)) == brute(rows)
    blocks = sd.stage(sd.pack_blocks(docs, "doc_id", "text", []), "blocks")
    flags = sd.fresh_path(spark, "flags")
    bits = sd.hash_rows(blocks, 6).repartition(4, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(sd.repeated_bits, sd._ANSWER)
    sd.answers_by_part(bits, flags, 4)
    sent = sd.string_rows(blocks, flags, 6, 6).selectExpr("bucket", "length(payload) AS n").groupBy("bucket").sum("n").collect()
    # a minimizer with fewer strings stays whole: runs are of at most 2 * WINDOW - K bytes
    even = sum(r[1] for r in sent) // 64
    assert max(r[1] for r in sent) < 2 * even + sd.HOT_STRINGS * (2 * sd.WINDOW - sd.K)


def test_empty_table(spark):
    assert sd.suffix_dedup(empty(spark)).count() == 0


def test_kept_text_and_carried_columns(spark):
    rows = [(1, prose(5, 40)), (2, "before " + prose(5, 40) + " after")]
    r = sd.suffix_dedup(frame(spark, rows), with_kept=True, carry=["kept", "count"]).where("doc_id = 2").first()
    assert r.kept.startswith("before") and r.kept.endswith("after") and r.n_removed >= len(prose(5, 40)) and r.rest["kept"] == "other"


@pytest.mark.parametrize("shard_bytes", [40, 200, 5000])
def test_merge_gives_sorted_rotations_and_prefixes(shard_bytes):
    r = np.random.default_rng(3)
    lengths = r.integers(0, 90, 30)
    data = r.integers(97, 99, lengths.sum()).astype(np.uint8)
    c, merged, prefix = bwt.merge(data, lengths, shard_bytes, 50)
    cut = np.append(0, np.cumsum(lengths))
    cyc = [data[a:b].astype(int).tolist() + [-1] for a, b in zip(cut, cut[1:], strict=False)]
    head = lambda x: tuple((cyc[c.string[x]] * 60)[c.offset[x] : c.offset[x] + 50])
    seen = [head(x) for x in merged]
    assert seen == sorted(seen)
    for k in range(1, len(seen)):
        same = next((i for i, (a, b) in enumerate(zip(seen[k - 1], seen[k], strict=True)) if a != b), 50)
        assert prefix[k] == same // bwt.Q * bwt.Q


def test_stable_order_of_wide_numbers():
    x = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32) // 7
    assert (bwt._stable(x) == np.argsort(x, kind="stable")).all()


def test_the_query_on_the_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = sd.op2_suffix_dedup(spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert got(out) == brute(rows)


def test_places_sort_with_their_keys_and_grams_hash_alike_everywhere():
    r = np.random.default_rng(4)
    for most in (3, 1 << 20, (1 << 41) - 1, (1 << 62) - 1):
        key = r.integers(0, most, 3000)
        got, order = bwt._sorted(key, most)
        assert (order == np.argsort(key, kind="stable")).all() and (got == key[order]).all()
    inter = r.integers(0, 4, 3000).astype(np.uint8)
    assert (bwt._places(inter, 4) == np.argsort(inter, kind="stable")).all() and len(bwt._sorted(inter[:0], 0)[0]) == 0
    h = r.integers(0, 500, 3000).astype(np.uint64)
    assert (sd.ranks(h) == np.searchsorted(np.unique(h), h)).all() and len(sd.ranks(h[:0])) == 0
    data = r.integers(0, 4, 90).astype(np.uint8)
    data[45:] = data[:45]
    whole = sd.gram_hashes(data)
    assert (whole[:26] == whole[45:]).all()
    assert all((sd.gram_hashes(data[k : k + n]) == whole[k : k + n - sd.K + 1]).all() for k in (0, 3) for n in (20, 21, 28, 50))


def test_blocks_stay_out_of_sparks_rows_and_come_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 4000)
    rows = [(k, prose(k, 60)) for k in range(60)]
    packed = sd.pack_blocks(frame(spark, rows, clash=False).coalesce(1), "doc_id", "text", []).collect()
    assert len(packed) == 1 and len(str(packed[0])) < 500
    sizes = [len(b.data) for b in sd._blocks(iter([pa.RecordBatch.from_pylist([packed[0].asDict()])]))]
    assert len(sizes) > 5 and max(sizes) < 4500 and sum(sizes) == packed[0].bytes == sum(len(t) for _, t in rows)


def test_marking_removed_bytes_needs_few_bytes_a_byte():
    n, none = 1 << 20, np.zeros(0, np.int64)
    block = SimpleNamespace(data=np.zeros(n, np.uint8), sizes=np.array([n]), ids=np.array([1]))
    tracemalloc.start()
    gone, begins = sd._apply(block, SimpleNamespace(first=none, n=none, doc=none, lengths=none, code=none), [])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not gone.any() and not begins.any() and most < 8 * n


def test_a_byte_under_all_windows_is_marked():
    n = 200
    block = SimpleNamespace(data=np.zeros(n, np.uint8), sizes=np.array([n]), ids=np.array([2]))
    every = np.array([n - sd.WINDOW + 1])
    strings = SimpleNamespace(first=np.array([0]), n=every, doc=np.array([0]), lengths=every + sd.WINDOW - 1, code=np.array([0]))
    gone, begins = sd._apply(block, strings, [sd._shorter(np.ones(every[0], np.int64))])
    assert gone.all() and begins.sum() == 1
