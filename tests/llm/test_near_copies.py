import random

import corpus_pipeline as cp
from colloquy.llm import near_copies as nc
from colloquy.llm.simhash import _signed
from pyspark.sql import functions as F

from tests.llm.helpers import edge_rows, frame, prose


def jaccard(x, y, words=5):
    cut = lambda t: {tuple(t.lower().split()[k : k + words]) for k in range(max(len(t.split()) - words + 1, 1))}
    return len(cut(x) & cut(y)) / len(cut(x) | cut(y))


def changed(text, at):
    words = text.split()
    for k in at:
        words[k] = f"changed{k}"
    return " ".join(words)


def test_stage_drops_copies_of_0_8_and_keeps_others(spark, sf_dir):
    base = prose(7, 400)
    near, far = changed(base, range(30, 390, 60)), changed(base, range(20, 380, 30))
    assert 0.8 <= jaccard(base, near) < 0.9 and jaccard(base, far) < 0.8 and jaccard(near, far) < 0.8
    rows = [*edge_rows(), (40, base), (41, near), (42, far)]
    docs = frame(spark, rows)
    kept = {r.doc_id for r in cp.drop_near_copies(spark, docs, sf_dir).collect()}
    assert 14 not in kept and 5 not in kept and 41 not in kept
    assert {1, 13, 40, 42, None} <= kept


def test_pairs_agree_with_brute_force_when_shards_are_cut(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(5)]
    codes = [b ^ sum({1 << r.randrange(64) for _ in range(r.randrange(14))}) for b in base for _ in range(40)]
    near = {(x, y) for x in range(len(codes)) for y in range(x) if (codes[x] ^ codes[y]).bit_count() <= nc.RADIUS}
    df = spark.createDataFrame([(k, _signed(c)) for k, c in enumerate(codes)], "id long, fp long").withColumn("comp", F.col("id"))
    for rows in (10, 1000):
        assert {tuple(x) for x in nc.near_pairs(df, False, rows).collect()} == near
        some = {tuple(x) for x in nc.near_pairs(df, True, rows).collect()}
        assert some <= near and components(some, len(codes)) == components(near, len(codes))
        first = {tuple(x) for x in nc.near_pairs(df, True, rows, nc.FIRST_CHOICES).collect()}
        met = components(first, len(codes))
        dealt = spark.createDataFrame([(k, _signed(c), met[k]) for k, c in enumerate(codes)], "id long, fp long, comp long")
        later = {tuple(x) for x in nc.near_pairs(dealt, True, rows).collect()}
        assert first | later <= near and all(met[x] != met[y] for x, y in later)
        assert components(first | later, len(codes)) == components(near, len(codes))


def components(pairs, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_sketches_never_reject_a_similar_pair():
    import numpy as np

    r = np.random.default_rng(3)
    sets, similar = [], []
    for size in (3, 40, 90, 400, 12_000):
        base = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
        for share in (0.0, 0.05, 0.1, 0.2, 0.5):
            new = np.unique(r.integers(0, 1 << 63, size).astype(np.uint64))
            sets += [base, np.unique(np.where(r.random(len(base)) < share, new[: len(base)], base))]
            similar.append(nc.similar(sets[-2], sets[-1]))
    n, sk = np.array([len(x) for x in sets]), np.array([nc.sketch(x) for x in sets])
    x = np.arange(0, len(sets), 2)
    got = nc.may_be_similar(n, sk, x, x + 1)
    assert all(g for g, s in zip(got, similar, strict=True) if s) and not got.all()


def test_shards_are_searched_by_a_tree_that_leaves_far_codes_out():
    import numpy as np

    r = random.Random(4)
    codes = [b ^ sum({1 << r.randrange(64) for _ in range(r.randrange(8))}) for b in (0, (1 << 64) - 1) for _ in range(400)]
    fps, every = np.array(codes, np.uint64), np.arange(800)
    tree = nc.bk_tree(fps, every)
    assert tree[1] is not None and all(len(child[0]) <= 400 for _, child in tree[2])
    asked = [(x, y) for q, rows in nc._meetings(tree, fps, every) for x in q.tolist() for y in rows.tolist()]
    near = {(x, y) for x in range(800) for y in range(800) if (codes[x] ^ codes[y]).bit_count() <= nc.RADIUS}
    assert len(asked) == len(set(asked)) <= 400 * 800 and near <= set(asked)
    none = np.zeros(800, np.int64)
    x, y = nc._spanning(every, fps, every, none)
    assert {*zip(x.tolist(), y.tolist(), strict=True)} <= near and components(zip(x.tolist(), y.tolist(), strict=True), 800) == components(near, 800)
    assert len(x) < 800


def test_a_pair_is_told_under_one_choice_only():
    import numpy as np

    r = random.Random(5)
    x = np.array([r.getrandbits(64) for _ in range(300)], np.uint64)
    y = x ^ np.array([sum({1 << r.randrange(64) for _ in range(r.randrange(1, nc.RADIUS + 1))}) for _ in x], np.uint64)
    for choices in (nc.CHOICES, nc.FIRST_CHOICES):
        told = sum(nc.first_met(x, y, k, tuple(choices)).astype(int) for k in range(len(choices)))
        assert (told == 1).all() if choices is nc.CHOICES else told.max() == 1


def test_a_dense_group_asks_for_no_more_pairs_than_codes(spark):
    r = random.Random(6)
    codes = [sum({1 << r.randrange(64) for _ in range(4)}) for _ in range(120)]
    extra = ["n", *(f"s{k}" for k in range(nc.SKETCH_BITS // 64))]
    rows = [(k, _signed(c), k % 3, 400, *[0] * (len(extra) - 1)) for k, c in enumerate(codes)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("id", "fp", "comp", *extra)))
    for size in (20, 1000):
        asked = [tuple(x) for x in nc.asked_pairs(df, size).collect()]
        assert 60 <= len(asked) <= 120 and all(a > b and a % 3 != b % 3 for a, b in asked)
        assert all((codes[a] ^ codes[b]).bit_count() <= nc.RADIUS for a, b in asked)
    joined = nc._joined(df.withColumn("wide", F.lit(0)), spark.createDataFrame([(4, 0)], "a long, b long"))
    assert {(x.comp, x.id % 3) for x in joined.collect()} == {(0, 0), (0, 1), (2, 2)}


def test_near_copies_of_a_dense_group_are_joined_as_by_all_pairs(spark):
    r = random.Random(7)
    base = prose(8, 300)
    rows = [(k, changed(base, r.sample(range(300), r.randrange(4, 16)))) for k in range(60)]
    near = {(x, y) for x in range(60) for y in range(x) if jaccard(rows[x][1], rows[y][1]) >= 0.8}
    assert 0 < len(near) < 60 * 59 // 2
    codes = [nc.fingerprint(t.encode(), nc.CODE_WORDS) for _, t in rows]
    near = {(x, y) for x, y in near if (codes[x] ^ codes[y]).bit_count() <= nc.RADIUS}
    kept = {x.doc_id for x in nc.first_copies(frame(spark, rows)).collect()}
    assert kept == set(components(near, 60))
