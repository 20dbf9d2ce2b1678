import hashlib
import re

from colloquy.llm import exact_dedup as xd
from pyspark.sql import functions as F

from tests.llm.helpers import edge_rows, empty, frame, prose
from tests.oracle import compare, connection


def normal(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    """(id, keep_id, size, sha) of each row, as text to sort by."""
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(str((i, keep[normal(t)], len(groups[normal(t)]), sha(normal(t)))) for i, t in rows)


ROWS = [*edge_rows(), (40, prose(1, 80).upper()), (41, "ÀB"), (42, "àb"), (43, "Àb"), (None, "only here"), (None, None)]


def check(out):
    got = out.collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(ROWS)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})  # one of each text, of repeated rows too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_agrees_with_brute_force(spark):
    check(xd.exact_dedup(frame(spark, ROWS)))


def test_hot_groups_and_a_full_filter_give_the_same(spark):
    check(xd.exact_dedup(frame(spark, ROWS), hot_share=10_000))
    check(xd.exact_dedup(frame(spark, ROWS), hot_share=1))
    many = [(i, f"text {i % 20_000}") for i in range(25_000)]
    out = xd.exact_dedup(frame(spark, many, clash=False), most_blocks=1)  # fewer cells than rows
    assert sorted(str(tuple(r)[:3] + (r.text_sha256,)) for r in out.collect()) == brute(many)


def test_rows_come_back_whole(spark):
    docs = frame(spark, ROWS)
    out = xd.distinct_documents(docs)
    assert out.columns == docs.columns
    assert sorted(normal(r.text) for r in out.collect()) == sorted({normal(t) for _, t in ROWS})


def test_the_filter_has_no_false_negative_and_few_false_positives(spark):
    rows = spark.range(60_000).select((F.col("id") % 50_000).alias("v"))
    hashed = rows.select(F.unhex(F.sha2(F.col("v").cast("string"), 256)).alias("digest"), "v")
    placed = xd._places(hashed, xd.blocks_for(60_000))
    asked = placed.join(xd.repeat_filter(placed), "block", "left").withColumn("again", xd._is_set("cell_1") & xd._is_set("cell_2"))
    n = {(r.twice, r.again): r["count"] for r in asked.groupBy((F.col("v") < 10_000).alias("twice"), "again").count().collect()}
    assert n[True, True] == 20_000 and (True, False) not in n
    assert n.get((False, True), 0) < 0.03 * 40_000


def test_no_python_in_the_plan_and_empty_table(spark):
    out = xd.exact_dedup(empty(spark))
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "InArrow" not in plan


def test_filter_sizes():
    assert [xd.blocks_for(n) for n in (0, 1, 2048, 2049, 5000, 10**12)] == [1, 1, 1, 2, 4, xd.MOST_BLOCKS]


def test_agrees_with_sql(spark, sf_dir):
    compare(xd.op11_exact_dedup(spark, sf_dir), connection(sf_dir), xd.OP11_SQL)
