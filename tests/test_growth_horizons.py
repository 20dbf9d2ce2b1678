import time

from colloquy.operators import training_rows


def test_what_tokens_hear_takes_time_in_proportion(spark):
    tokens = spark.range(150_000).selectExpr("1L AS k", "id AS token", "id * 3 AS at")
    segments = spark.range(1, 1000).selectExpr("1L AS k", "id * 300 AS at", "id * 1000 AS start")
    at = time.time()
    got = training_rows.heard_from(tokens, segments, "k", 20_000, 80)
    row = got.selectExpr("count(*) AS n", "sum(start) AS s", "min(start) AS m").first()
    assert (row.n, row.m) == (150_000, 1000) and row.s == sum(max(min(3 * t // 300, 999), 1) * 1000 for t in range(150_000))
    assert time.time() - at < 30
