import zlib

import numpy as np
from colloquy.llm import sentencepiece_trie as sp
from colloquy.llm.tokens import vocabulary_path
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import edge_rows, empty, frame

MODEL = vocabulary_path("piece_bpe_32k.model")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_agree_with_the_library(spark):
    lib = library()
    rows = [*edge_rows(), (60, "  two  blanks  "), (61, "日本語と English 🎉"), (62, "tab\tnew\nline"), (63, " "), (64, "straße naïve")]
    out = sp.encode_documents(frame(spark, rows), MODEL).collect()
    by = {}
    for i, t in rows:
        by.setdefault(i, []).append(lib.encode(t or ""))
    assert len(out) == len(rows)
    for r in out:
        assert list(r.ids) in by[r.doc_id]
        assert r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.decoded_same
    assert sp.encode_documents(empty(spark), MODEL).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=97, max_codepoint=122), min_size=1, max_size=14), min_size=1, max_size=12))
def test_random_words(words):
    import pyarrow as pa

    text = " ".join(words)
    ids, counts = sp.encoder(MODEL).encode(pa.array([text, "", text]))
    want = library().encode(text)
    assert ids.tolist() == want + want and counts.tolist() == [len(want), 0, len(want)]
    assert sp.encoder(MODEL).decode(ids, counts) == [text, "", text]


@settings(max_examples=150, deadline=None)
@given(st.text("ab c\u2581\u00e9\u65e5", max_size=12))
def test_texts_with_the_mark_itself(text):
    import pyarrow as pa

    ids, counts = sp.encoder(MODEL).encode(pa.array([text]))
    assert ids.tolist() == library().encode(text) and counts.tolist() == [len(ids)]


def test_the_query_agrees_with_the_library(spark, sf_dir):
    lib = library()
    want = {r.doc_id: lib.encode(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = sp.op10_sentencepiece(spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("n_ids", "bigint"), ("ids_crc32", "bigint"), ("decoded_same", "boolean")]
    got = {r.doc_id: (r.n_ids, r.ids_crc32) for r in out.collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
