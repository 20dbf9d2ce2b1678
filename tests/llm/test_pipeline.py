import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.helpers import edge_rows, empty, frame


def documents(df):
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def test_stages_keep_columns_and_near_copies_go(spark, sf_dir):
    docs = documents(frame(spark, edge_rows()))
    for name, step in cp.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r["rank"] == "other" and r["_own"] == "other" for r in rows), name
        if name == "simhash":
            ids = {r.doc_id for r in rows}
            assert {1, None} <= ids and 5 not in ids and 13 in ids
        if name == "suffix_dedup":
            assert all(r.n_chars == len(r.text) for r in rows)


def test_stages_take_empty_tables(spark, sf_dir):
    for name, step in cp.STAGES:
        assert step(spark, documents(empty(spark)), sf_dir).count() == 0, name


def test_the_whole_pipeline(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = cp.run(spark, sf_dir).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) <= set(docs) and 10 * len(pieces) > len(docs)
    assert len({docs[i] for i in pieces}) == len(pieces)  # of equal texts one stays
    for own in pieces.values():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (k, at) and 0 < length <= 2048
            at += length
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_the_whole_pipeline_without_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
