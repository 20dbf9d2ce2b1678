from colloquy.operators import cursor


def test_cuts_need_no_window_over_every_frame(spark):
    frames = spark.range(3000).selectExpr("id % 2 AS k", "id div 2 AS i", "id * 7919 % 101 AS e")
    cuts = cursor.next_cuts(frames, "k", "i", "e", 400, 50, 4, 10, block=500)
    assert "Window" not in cuts._jdf.queryExecution().optimizedPlan().toString()
    e = {k: [(2 * i + k) * 7919 % 101 for i in range(1500)] for k in (0, 1)}
    for r in cuts.collect():
        if r.last:
            assert r.cut == 1500 and r.start + 400 >= 1500
        else:
            at = min(range(r.start + 350, r.start + 397), key=lambda x: (sum(e[r.k][x : x + 4]), x))
            assert r.cut == at + 2
    assert cuts.count() == 2 * (1500 - 9)
