import hashlib
import math
import random

import numpy as np
from colloquy.llm import centroids as ct
from pyspark.sql import functions as F

from tests.oracle import compare, connection

KIND = "vec_id long, embedding array<float>"


def brute(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(1024 * float(np.float32(x))) for x in v]
        if all(-ct.MOST <= x <= ct.MOST for x in q):
            kept.append((i, q))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cents = [q for _, q in sorted((sha(f"3:{i}"), q) for i, q in kept if i is not None)[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(q)[1] for _, q in kept]
        for n in range(len(cents)):
            own = [q for (_, q), a in zip(kept, at, strict=True) if a == n]
            if own:
                cents[n] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *nearest(q)[::-1]) for i, q in kept]
    sums = {n: sum(d for _, c, d in out if c == n) for n in range(len(cents))}
    return sorted(str((i, c, d, sums[c], sum(sums.values()), sha(",".join(map(str, cents[c]))))) for i, c, d in out)


def rows(n, size=4, seed=1):
    r = random.Random(seed)
    return [(i, [r.gauss(3 * (i % 3), 1) for _ in range(size)]) for i in range(n)]


def cluster(spark, data, **kw):
    df = spark.createDataFrame(data, KIND).repartition(3)
    for c in ("cluster", "q", "distance", "label", "n"):
        df = df.withColumn(c, F.lit("other"))
    return ct.centroid_clusters(df, **kw)[0]


def as_text(out):
    return sorted(str((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in out.collect())


ODD = [
    (900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 2.0, 3.0]), (905, [1.0, math.nan, 2.0, 3.0]),
    (906, [math.inf, 1.0, 2.0, 3.0]), (907, [1.0, -math.inf, 2.0, 3.0]), (908, [3e38, 0.0, 0.0, 0.0]), (909, [131072.0, -131072.0, 0.0, 0.0]),
    (910, [-0.0001, 0.0, -1.5, 1e-30]), (None, [1.0, 2.0, 3.0, 4.0]), (7, [0.5] * 4), (7, [0.5] * 4), (7, [0.25] * 4),
]


def test_agrees_with_brute_force(spark):
    data = rows(200) + ODD
    assert as_text(cluster(spark, data, size=4, k=5, rounds=4)) == brute(data, 5, 4, 4)


def test_ties_go_to_the_lower_number_and_empty_clusters_stay(spark):
    same = [(i, [1.0, 1.0]) for i in range(6)] + [(10, [2.0, 2.0])]
    assert as_text(cluster(spark, same, size=2, k=4, rounds=3)) == brute(same, 4, 3, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    two = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert as_text(cluster(spark, two, size=2)) == brute(two, 8, 10, 2)
    assert cluster(spark, []).collect() == cluster(spark, ODD[:3]).collect() == []
    assert cluster(spark, [(None, [1.0, 2.0])], size=2).collect() == []


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(rows(300, 3, 2), KIND)
    runs = [as_text(ct.centroid_clusters(df.repartition(n), size=3, rounds=6)[0]) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_agrees_with_sql(spark, sf_dir):
    assert compare(ct.op12_lloyd(spark, sf_dir), connection(sf_dir), ct.OP12_SQL)
