from colloquy.operators import metrics


def test_recordings_are_scored_many_a_batch(spark):
    rows = [(k, p, f"S{p % 2}", f"words of turn {p} {k}", 1000 * p, 1000 * p + 900) for k in range(4) for p in range(5)]
    ref = spark.createDataFrame(rows, "k long, pos int, speaker string, text string, start long, end long")
    hyp = ref.selectExpr("k", "pos", "concat('H', speaker) AS speaker", "text", "start + 40 AS start", "end + 60 AS end")
    for got in (metrics.cpwer(ref, hyp, "k"), metrics.timestamp_error(ref, hyp, "k"), metrics.speaker_errors(ref, hyp, "k")):
        assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.matched, r.unmatched, r.mae_ms) for r in metrics.timestamp_error(ref, hyp, "k").collect()} == {(5, 0, 50.0)}
    assert {r.edits for r in metrics.cpwer(ref, hyp, "k").collect()} == {0.0}
    assert {(r.speaker, r.mapped) for r in metrics.speaker_map(ref, hyp, "k").collect()} == {("HS0", "S0"), ("HS1", "S1")}
