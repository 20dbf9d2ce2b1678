import random

import numpy as np
import pytest
from colloquy.operators import components, constrained, cursor, linkage, speaker_count, vectors
from colloquy.plans import linking
from pyspark.sql import functions as F


# ---------------------------------------------------------------- windows cut at pauses
def walk(energy, window, snap, pool, least):
    """One recording from its first frame to its last."""
    out, at = [], 0
    while len(energy) - at >= least:
        piece = energy[at : at + window]
        last = at + window >= len(energy)
        best = min(range(window - snap, window - pool + 1), key=lambda o: sum(piece[o : o + pool])) if not last else None
        cut = len(energy) if last else at + best + pool // 2
        out.append((len(out), at, cut, last))
        if last:
            break
        at = cut
    return out


@pytest.mark.parametrize(("window", "snap", "pool", "least", "block"), [(40, 12, 4, 10, 50), (40, 40 - 1, 1, 1, 40), (60, 8, 8, 10, 1000), (25, 5, 4, 3, 7)])
def test_windows_as_a_walk(spark, window, snap, pool, least, block):
    r = random.Random(window)
    sounds = {k: [r.randrange(r.choice([2, 50])) for _ in range(n)] for k, n in enumerate([0, 1, 9, 10, 11, 39, 40, 41, 400, 1501])}
    sounds["quiet"] = [0] * 300
    df = spark.createDataFrame([(str(k), i, e) for k, v in sounds.items() for i, e in enumerate(v)], "k string, i long, e long").repartition(3)
    got = {}
    for x in cursor.pause_windows(df, "k", "i", "e", window, snap, pool, least, block).orderBy("window").collect():
        got.setdefault(x.k, []).append((x.window, x.start, x.cut, x.last))
    assert got == {str(k): w for k, v in sounds.items() if (w := walk(v, window, snap, pool, least))}


def test_one_long_recording_is_many_tasks_work(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(90)).alias("e"))
    cuts = cursor.next_cuts(df, "k", "i", "e", 100, 30, 4, 10, block=1000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert cuts.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    energy = [x.e for x in df.orderBy("i").collect()]
    got = cursor.pause_windows(df, "k", "i", "e", 100, 30, 4, 10, block=1000).orderBy("window").collect()
    assert [(x.window, x.start, x.cut, x.last) for x in got] == walk(energy, 100, 30, 4, 10)
    assert cursor.pause_windows(df.limit(0), "k", "i", "e", 100, 30).count() == 0
    with pytest.raises(ValueError):
        cursor.next_cuts(df, "k", "i", "e", 30, 30, 4, 10)


def test_segments_before_a_cut(spark):
    w = spark.createDataFrame([("a", 0, 0, 100, False), ("a", 1, 100, 180, True)], "k string, window int, start long, cut long, last boolean")
    s = spark.createDataFrame([("a", 0, 98), ("a", 0, 99), ("a", 1, 150), ("b", 0, 1)], "k string, window int, start long")
    assert sorted(x.start for x in cursor.cut_segments(s, w, "k", 1).collect()) == [98, 150]


# ---------------------------------------------------------------- components
def test_a_chain_of_ten_thousand_links(spark):
    e = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.connected(e, "a", "b")
    assert got.count() == 10_001 and [x.component for x in got.select("component").distinct().collect()] == [0]


def test_components_of_structs_loops_and_nulls(spark):
    r = random.Random(4)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(90, 90), (7, 7)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    rows = [((f"r{a:03d}", a), (f"r{b:03d}", b)) for a, b in pairs] + [(None, ("r001", 1)), (None, None)] + [(("r001", 1), ("r002", 2))] * 0
    df = spark.createDataFrame(rows, "x struct<n:string,i:long>, y struct<n:string,i:long>")
    got = {x.node.i: x.component.i for x in components.connected(df, "x", "y").collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected(df.limit(0), "x", "y").count() == 0


def test_must_links_need_time_that_both_windows_cover(spark):
    rows = [("k", 0, "a", 0, 60_000), ("k", 0, "b", 39_000, 40_900), ("k", 40_000, "x", 40_000, 41_500), ("k", 40_000, "y", 40_000, 41_000), ("k", 40_000, "y", 50_000, 50_002), ("k", 80_000, "z", 80_000, 120_000), ("j", 40_000, "x", 40_000, 99_000)]
    df = spark.createDataFrame(rows, "k string, offset long, speaker string, start long, end long")
    links = {(x.k, x.offset, x.a, x.b, x.shared) for x in components.must_links(df, "k", 60_000, 40_000, 1000).collect()}
    assert links == {("k", 0, "a", "x", 1500), ("k", 0, "a", "y", 1002)}
    got = {(x.k, x.offset, x.speaker): (x.first_offset, x.first_speaker) for x in components.linked_units(df, "k", 60_000, 40_000, 1000).collect()}
    assert got == {("k", 0, "a"): (0, "a"), ("k", 40_000, "x"): (0, "a"), ("k", 40_000, "y"): (0, "a"), ("k", 0, "b"): (0, "b"), ("k", 80_000, "z"): (80_000, "z"), ("j", 40_000, "x"): (40_000, "x")}
    v = spark.createDataFrame([("k", 0, "a", [1.0, 0.0]), ("k", 40_000, "x", [0.0, 2.0])], "k string, offset long, speaker string, v array<double>")
    mean = components.group_means(components.linked_units(df, "k", 60_000, 40_000, 1000), v, "k", "v").collect()
    assert [(x.first_offset, x.first_speaker, [round(y, 6) for y in x.centroid]) for x in mean] == [(0, "a", [0.707107, 0.707107])]


# ---------------------------------------------------------------- linkage
def greedy(x, method):
    """Merge heights and the clusters after each merge, by the definition of each linkage."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    base = 1 - u @ u.T
    groups, out = [[k] for k in range(len(x))], []
    ward = {(i, j): base[i, j] for i in range(len(x)) for j in range(i)}

    def between(a, b):
        pairs = base[np.ix_(a, b)]
        return pairs.mean() if method == "average" else pairs.max() if method == "complete" else ward[tuple(sorted((a[0], b[0]), reverse=True))]

    while len(groups) > 1:
        d, i, j = min((between(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if method == "ward":
            a, b = groups[i], groups[j]
            for c in groups:
                if c not in (a, b):
                    n, m, k = len(a), len(b), len(c)
                    ward[tuple(sorted((a[0], c[0]), reverse=True))] = np.sqrt(((n + k) * between(a, c) ** 2 + (m + k) * between(b, c) ** 2 - k * d**2) / (n + m + k))
        groups[i] = groups[i] + groups.pop(j)
        out.append((d, [sorted(g) for g in groups]))
    return out


@pytest.mark.parametrize("method", ["average", "complete", "ward"])
def test_merges_and_all_cuts_as_greedy_linkage(method):
    r = np.random.default_rng(5)
    for n, size in [(1, 3), (2, 3), (30, 3), (45, 8)]:
        x = r.normal(size=(n, size)) + 2 * np.eye(size)[r.integers(size, size=n)]
        want = greedy(x, method)
        steps = linkage.merge_steps(x, method)
        assert np.allclose([s[0] for s in steps], [w[0] for w in want])
        for t in [*np.linspace(0, 1.9, 20)]:
            groups = next((w[1] for w in reversed(want) if w[0] <= t), [[k] for k in range(n)])
            label = linkage.flat_clusters(x, t, method)
            assert sorted(np.flatnonzero(label == k).tolist() for k in set(label.tolist())) == sorted(groups)
            assert list(dict.fromkeys(label.tolist())) == list(range(len(groups)))
    with pytest.raises(ValueError):
        linkage.merge_steps(np.eye(2), "middle")


def test_average_linkage_holds_no_matrix():
    import tracemalloc

    x = np.random.default_rng(1).normal(size=(1500, 8))
    tracemalloc.start()
    linkage.merge_steps(x)
    assert tracemalloc.get_traced_memory()[1] < 1500 * 1500 * 8 / 8
    tracemalloc.stop()


def voices(spark, seed, sizes, spread=0.2, size=6):
    """Recordings of planted speakers; null, zero and repeated vectors among them."""
    r, rows = np.random.default_rng(seed), []
    for rec, n in sizes.items():
        for k in range(n):
            v = np.eye(size)[k % 3] + spread * r.normal(size=size)
            rows.append((rec, k, k % 3, v.tolist()))
    rows += [("odd", 0, 0, None), ("odd", 1, 0, [0.0] * size), ("odd", 2, 0, [1.0] + [0.0] * (size - 1)), ("odd", 3, 0, [float("nan")] * size)]
    return spark.createDataFrame(rows, "rec string, item long, true long, v array<double>").repartition(3)


def test_cuts_at_every_threshold(spark):
    df = voices(spark, 3, {"a": 20, "b": 7, "c": 1})
    tree = linkage.dendrogram(df, "rec", "item", "v")
    ts = [0.0, 0.05, 0.3, 0.9, 2.0]
    got = {}
    for x in linkage.cuts(tree, "rec", "item", ts).orderBy("item").collect():
        got.setdefault((x.rec, x.threshold), []).append(x.cluster)
    for rec in "abc":
        m = np.array([x.v for x in df.where(F.col("rec") == rec).orderBy("item").collect()])
        for t in ts:
            assert got[rec, t] == (linkage.flat_clusters(m, t) + 1).tolist()
    assert got["odd", 0.3] == [1]


def test_cut_into_a_number_of_clusters(spark):
    df = voices(spark, 4, {"a": 30, "b": 4})
    wanted = spark.createDataFrame([("a", 3), ("b", 9), ("odd", 2)], "rec string, k int")
    got = {}
    for x in linkage.cut_into(linkage.dendrogram(df, "rec", "item", "v"), "rec", "item", wanted).orderBy("item").collect():
        got.setdefault(x.rec, []).append(x.cluster)
    assert got == {"a": [1, 2, 3] * 10, "b": [1, 2, 3, 4], "odd": [1]}


def test_labels_of_segments_and_units(spark):
    seg = spark.createDataFrame([("r", k, k // 4, "x" if k % 2 else "y") for k in range(12)], "rec string, pos long, window long, tag string")
    pos = spark.createDataFrame([("r", k, [1.0, 0.0] if k % 3 else [0.0, 1.0]) for k in range(12) if k not in (0, 5)], "rec string, pos long, vector array<double>")
    got = [x.speaker for x in linkage.swept_segments(seg, pos, "rec", "pos", ["pos"], "average", [0.5]).orderBy("pos").collect()]
    assert got == ["S01", "S01", "S01", "S02", "S01", "S01", "S02", "S01", "S01", "S02", "S01", "S01"]
    unit = spark.createDataFrame([("r", w, t, [1.0, 0.0] if t == "x" else [0.0, 1.0]) for w in range(3) for t in "xy"], "rec string, window long, tag string, vector array<double>")
    got = [x.speaker for x in linkage.swept_segments(seg, unit, "rec", "pos", ["window", "tag"], "complete", [0.5]).orderBy("pos").collect()]
    assert got == ["S01", "S02"] * 6


# ---------------------------------------------------------------- constraints
def constrained_slow(x, windows, seconds, threshold, penalty, small):
    at = [v / np.linalg.norm(v) for v in x]
    groups, n = {k: {k} for k in range(len(x))}, [1] * len(x)
    tied = lambda i, j: any(windows[a] == windows[b] for a in groups[i] for b in groups[j])
    while True:
        best, pair = threshold, None
        for i in sorted(groups):
            for j in sorted(groups):
                if i < j and (e := float(at[i] @ at[j]) - penalty * tied(i, j)) > best:
                    best, pair = e, (i, j)
        if pair is None:
            break
        i, j = pair
        groups[i] |= groups.pop(j)
        at[i] = at[i] * n[i] + at[j] * n[j]
        at[i] /= np.linalg.norm(at[i])
        n[i] += n[j]
    total = {i: sum(seconds[k] for k in g) for i, g in groups.items()}
    large = [i for i in groups if total[i] >= small]
    for i in sorted((i for i in groups if total[i] < small), key=lambda i: total[i]):
        free = [(float(at[i] @ at[j]), j) for j in large if not tied(i, j)]
        if free:
            groups[max(free)[1]] |= groups.pop(i)
    label = [0] * len(x)
    for k, i in enumerate(sorted(groups)):
        for u in groups[i]:
            label[u] = k
    return label


def test_constrained_clusters_as_the_slow_version():
    r = np.random.default_rng(8)
    for n, threshold, penalty, small in [(1, 0.5, 0.35, 8), (2, 0.5, 0.35, 8), (40, 0.55, 0.35, 8), (40, 0.2, 0.9, 20), (60, -0.5, 0.1, 0), (50, 0.55, 0.0, 30)]:
        for _ in range(3):
            x = r.normal(size=(n, 4)) + 2 * np.eye(4)[r.integers(4, size=n)]
            windows, seconds = r.integers(max(2, n // 4), size=n).tolist(), r.uniform(0.5, 12, size=n)
            got = constrained.constrained_clusters(x, windows, seconds, threshold, penalty, small)
            want = constrained_slow(x, windows, seconds, threshold, penalty, small)
            assert [set(np.flatnonzero(got == k).tolist()) for k in dict.fromkeys(got.tolist())] == [{u for u, y in enumerate(want) if y == k} for k in dict.fromkeys(want)]


def test_units_pool_their_first_seconds_and_orphans_keep_their_tag(spark):
    rows = [("r", 0, "S01", 0, 20.0, [1.0, 0.0]), ("r", 0, "S01", 1, 20.0, [0.0, 1.0]), ("r", 0, "S01", 2, 5.0, [0.0, 9.0]), ("r", 0, "S02", 3, 9.0, [0.0, 1.0]), ("r", 1, "S01", 4, 9.0, [0.1, 1.0]), ("r", 1, "S07", 5, 3.0, None)]
    seg = spark.createDataFrame(rows, "rec string, window long, tag string, pos long, seconds double, v array<double>")
    units = constrained.pooled_units(seg, "rec", "window", "tag", "pos", "seconds", "v")
    got = {(x.window, x.tag): x for x in units.collect()}
    assert np.allclose(got[0, "S01"].vector, np.array([20, 10]) / 500**0.5) and got[0, "S01"].seconds == 45.0 and got[1, "S07"].vector is None
    speakers = constrained.constrained_speakers(units, "rec", "window", "tag")
    assert {(x.window, x.tag): x.speaker for x in speakers.collect()} == {(0, "S01"): "S01", (0, "S02"): "S02", (1, "S01"): "S02", (1, "S07"): "S07"}
    assert constrained.with_speakers(seg, speakers, "rec", "window", "tag").count() == 6
    assert [tuple(x) for x in constrained.speaker_counts(speakers, "rec").collect()] == [("r", 4, 3, "S02")]
    assert constrained.constrained_speakers(units.limit(0), "rec", "window", "tag").count() == 0


def test_the_constrained_query_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    want = {}
    for rec in sorted({r.vec_id // 100 for r in rows}):
        units, order = {}, []
        for r in rows:
            if r.vec_id // 100 == rec:
                key = (r.vec_id // 10, f"S0{r.label % 3 + 1}")
                if key not in units:
                    order.append(key)
                u = units.setdefault(key, {"s": 0.0, "left": 30.0, "v": np.zeros(64)})
                s = float(r.vec_id % 4 + 1)
                use = min(s, u["left"])
                u["s"], u["left"] = u["s"] + s, u["left"] - use
                if r.vec_id % 37 != 5:
                    v = np.array(r.embedding, float)
                    u["v"] += use * v / np.linalg.norm(v)
        heard = [k for k in order if np.linalg.norm(units[k]["v"]) > 1e-8]
        got = constrained_slow([units[k]["v"] for k in heard], [k[0] for k in heard], [units[k]["s"] for k in heard], 0.55, 0.35, 8.0)
        want |= {(rec, *k): k[1] for k in order if k not in heard} | {(rec, *k): f"S{g + 1:02d}" for k, g in zip(heard, got, strict=True)}
    assert {(x.rec, x.window, x.tag): x.speaker for x in linking.constrained_speakers(spark, sf_dir).collect()} == want


# ---------------------------------------------------------------- numbers of speakers
def slow_count(x, most):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    if len(x) < 3:
        return len(x)
    a = x @ x.T
    d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-9))
    ev = np.sort(np.linalg.eigvalsh(np.eye(len(a)) - d[:, None] * a * d[None, :]))
    return int(np.argmax(np.diff(ev[: min(most, len(ev) - 1) + 1])[1:]) + 2)


def test_planted_speakers_are_counted(spark):
    df = voices(spark, 6, {"many": 90, "few": 5, "two": 2, "one": 1}, spread=0.1)
    for most in (10, 9):
        got = {x.rec: (x.n, x.k) for x in speaker_count.estimated_count(df, "rec", "v", most).collect()}
        for rec, n in (("many", 90), ("few", 5), ("two", 2), ("one", 1)):
            x = np.array([r.v for r in df.where(F.col("rec") == rec).collect()])
            assert got[rec] == (n, slow_count(x, most))
        assert got["many"] == (90, 3) and got["odd"] == (1, 1)


def test_the_count_of_every_recording(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = {x.rec: (x.of_windows, x.of_units) for x in linking.estimated_speakers(spark, sf_dir).collect()}
    by = {}
    for r in rows:
        by.setdefault(r.vec_id // 100, []).append(r.embedding)
    assert got == {k: (slow_count(np.array(v, float), 10), slow_count(np.array(v, float), 9)) for k, v in by.items()}


def test_regions_of_planted_speakers(spark):
    rows = [("r", k, k * 750, k * 750 + 2000, (np.eye(4)[[0, 1, 0][k // 10]] + 0.05 * np.eye(4)[k % 4]).tolist()) for k in range(30)]
    rows[4] = (*rows[4][:4], [0.0, 1.0, 0.0, 0.0])  # one window alone is smoothed away
    df = spark.createDataFrame(rows, "rec string, k long, start long, end long, v array<double>")
    got = [(x.start, x.end, x.speaker, x.n) for x in speaker_count.diarized(df, "rec", "k", "v", 750).orderBy("start").collect()]
    assert got == [(0, 8750, "SPEAKER_0", 10), (7500, 16250, "SPEAKER_1", 10), (15000, 23750, "SPEAKER_0", 10)]
    one = speaker_count.diarized(df, "rec", "k", "v", 750, counts=spark.createDataFrame([("r", 1)], "rec string, k int"))
    assert [(x.start, x.end, x.speaker) for x in one.collect()] == [(0, 23750, "SPEAKER_0")]


def test_rows_only_queries_keep_their_rows(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    assert linking.diarized_regions(spark, sf_dir).agg(F.sum("n")).first()[0] == n
    got = linking.swept_labels(spark, sf_dir).collect()
    assert len(got) == 3 * 2 * len(linking.THRESHOLDS) and all(0 < r.purity <= 1 for r in got)


def test_labels_of_any_type(spark):
    e = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "who string, centroid array<double>")
    rows = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.1]), (3, [0.0, 0.0])], "i long, v array<double>")
    got = {x.i: (x.nearest, round(x.similarity, 6)) for x in vectors.nearest(rows, "v", e, "who").collect()}
    assert got == {1: ("a", 1.0), 2: ("c", 1.0), 3: ("a", 0.0)}


def test_speakers_of_the_whole_recording(spark):
    rows = [("r", 0, 0.2, [1.0, 0.0], "x"), ("r", 1, 1.0, [0.0, 1.0], "x"), ("r", 2, 1.0, [1.0, 0.1], "x"), ("r", 3, 1.0, [0.1, 1.0], "x"), ("r", 4, 1.0, None, "x"), ("s", 0, 1.0, [1.0, 0.0], "y"), ("s", 1, 0.1, [1.0, 0.0], "z"), ("t", 0, 0.1, None, "w")]
    df = spark.createDataFrame(rows, "rec string, pos long, sec double, v array<double>, speaker string")
    got = sorted((r.rec, r.pos, r.speaker) for r in linkage.global_speakers(df, "rec", "pos", "sec", "v").collect())
    assert got == [("r", 1, "S01"), ("r", 2, "S02"), ("r", 3, "S01"), ("s", 0, "y"), ("s", 1, "z"), ("t", 0, "w")]


def test_clusters_at_all_thresholds_are_the_cuts_of_the_tree(spark):
    r = np.random.default_rng(8)
    rows = [("ab"[k % 2], k, r.normal(size=5).tolist() if k % 7 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "rec string, item long, v array<double>")
    for method in ("average", "complete", "ward"):
        cut = linkage.cuts(linkage.dendrogram(df, "rec", "item", "v", method), "rec", "item", [0.3, 0.8, 1.1])
        at = {(x.rec, x.threshold, x.item): x.cluster for x in cut.collect()}
        got = linkage.swept_clusters(df, "rec", "item", "v", method, [0.3, 0.8, 1.1]).collect()
        assert {(x.rec, t, x.item): c for x in got for t, c in zip([0.3, 0.8, 1.1], x.clusters, strict=True)} == at
