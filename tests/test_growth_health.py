from collections import Counter

from colloquy.operators import fusion


def test_runs_of_letters_are_no_rows(spark):
    texts = ["", "short", "abcabcabcabcabcabcabcabc", "é漢字" * 9 + "x" * 30, "a" * 12, "a" * 13]
    rows = [(k, 0, 0, 10, "S", t) for k, t in enumerate(texts)]
    got = fusion.health(spark.createDataFrame(rows, "k long, pos int, start long, end long, speaker string, text string"), "k")
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {k: max(Counter(t[i : i + 12] for i in range(len(t) - 12)).values(), default=0) for k, t in enumerate(texts)}
    assert {r.k: r.top_gram for r in got.collect()} == want
