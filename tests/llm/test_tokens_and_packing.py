import functools
import zlib

import numpy as np
from colloquy.llm import packing, rans
from colloquy.llm.common import fresh_path
from colloquy.llm.tokens import tokenizer, vocabulary_path
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_rows, empty, frame

ODD = [(40, "tabs\tand  two blanks\n\nlines "), (41, " starts and ends blank "), (42, "日本語 text 🎉 mixed <|endoftext|>"), (43, "　wide　space x")]


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def library_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_give_back_the_library_ids_in_order(spark):
    rows = [r for r in [*edge_rows(), *ODD] if r[0] is not None]
    manifest, freq = rans.token_files(frame(spark, rows), fresh_path(spark, "t"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in rans.read_files(manifest, freq).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library_ids(t)
        want.append((at, i, len(ids), crc(ids)))
        at += len(ids)
    assert got == want


def test_files_of_an_empty_table_and_of_null_ids(spark):
    manifest, freq = rans.token_files(empty(spark), fresh_path(spark, "t"))
    assert rans.read_files(manifest, freq).count() == 0
    manifest, freq = rans.token_files(frame(spark, [(None, "a b"), (1, "c")]), fresh_path(spark, "t"))
    assert [r.doc_id for r in rans.read_files(manifest, freq).orderBy("start").collect()] == [None, 1]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6000), st.integers(0, 3))
def test_coder_round_trip(tokens, lift):
    x = np.array(tokens, np.int64) * (lift + 1)
    coder = rans.Coder(rans.scaled(np.bincount(x, minlength=300)))
    assert (coder.decode(coder.encode(x), len(x)) == x).all()


def test_a_damaged_block_is_noticed(spark, tmp_path):
    coder = rans.Coder(rans.scaled(np.ones(10, np.int64)))
    parts = list(rans._file_bytes(coder, np.array([1]), np.array([50]), iter([np.arange(50) % 10])))
    whole = bytearray(b"".join(parts))
    whole[3] ^= 1
    (tmp_path / "f").write_bytes(whole)
    with rans.RangeReader(f"file://{tmp_path}/f") as r:
        _, _, marks = rans.read_footer(r)
        try:
            rans.read_tokens(r, coder, marks, 0, 50)
        except ValueError:
            return
    raise AssertionError("read a damaged block")


def check_packing(pieces, rows, capacity):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, t in rows:
        ids, own = library_ids(t), sorted(by_doc[i], key=lambda p: p.piece)
        assert sum(p.length for p in own) == len(ids) and len(own) == -(-len(ids) // capacity)
        assert all(p.length == capacity for p in own[1:])
        for k, p in enumerate(own):
            assert p.piece == k and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_packing_is_whole_and_gapless(spark):
    rows = list({r[0]: r for r in [*edge_rows(), *ODD] if r[0] is not None}.values())
    out = packing.pack_documents(frame(spark, rows), capacity=128).collect()
    n = check_packing(out, rows, 128)
    assert n <= -(-sum(p.length for p in out) // 128) + 2
    assert packing.pack_documents(empty(spark)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65)
    bins = packing.plan_bins(counts, 64)
    used = np.zeros(65, np.int64)
    for b, m in bins:
        assert sum(b) <= 64 and m > 0
        np.add.at(used, list(b), m)
    assert (used == counts).all()


def test_exact_complements_fill_their_gaps():
    counts = np.zeros(101, np.int64)
    for length in (60, 40, 70, 20, 10, 55, 25, 15, 5):
        counts[length] += 3
    assert sum(m for _, m in packing.plan_bins(counts, 100)) == 9


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "<|endoftext|>", "\n", "é", "日本", "12", "\t", "'s", "▁", "\u00a0"]), max_size=12))
def test_any_text_gives_the_library_s_ids(parts):
    import pyarrow as pa

    texts = ["".join(parts), "plain words here", "".join(reversed(parts))]
    ids, counts = tokenizer(vocabulary_path()).encode(pa.array(texts))
    want = [library_ids(t)[:-1] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == [len(x) for x in want]


def test_the_queries_on_whole_tables(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    out = rans.op6_token_files(spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    at, want = 0, []
    for i, t in docs:
        ids = library_ids(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in out.collect()) == want
    out = packing.op7_packing(spark, sf_dir)
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    pieces = out.collect()
    n = check_packing(pieces, docs, 2048)
    assert n <= -(-sum(p.length for p in pieces) // 2048) * 1.05 + 1


def test_repeated_rows_and_null_ids_are_packed_too(spark):
    rows = [(None, "a b"), (None, "a b"), (5, "c"), (5, "c"), (6, None)]
    out = packing.pack_documents(frame(spark, rows), capacity=16).collect()
    assert sorted(p.length for p in out) == sorted(len(library_ids(t)) for _, t in rows)
    assert sum(p.doc_id is None for p in out) == 2 and len({(p.sequence_id, p.offset) for p in out}) == 5
    manifest, freq = rans.token_files(frame(spark, rows), fresh_path(spark, "t"))
    got = rans.read_files(manifest, freq).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(library_ids(t)) for _, t in rows)
