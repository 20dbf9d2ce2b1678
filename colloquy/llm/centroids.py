"""Plain Lloyd clustering over integer vectors.

Centroids are broadcast, ``k`` times ``size`` integers whatever the table.  In each round every
task takes its vectors' squared distances to each centroid in NumPy and adds up what it
assigns; the tasks' integer sums meet in a ``groupBy``, so no vector shuffles, and as sums of
integers do not depend on their order, every run gives the same centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import drop_stage, stage, table

SCALE = 1024
#: Components beyond this have squared distances that a long cannot hold.
MOST = 1 << 27
CLUSTERS, ROUNDS, SIZE, SEED = 8, 10, 64, 3


def integer_vector(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of each component; null unless all components are finite and within ``MOST``."""
    number = F.transform(vector, lambda x: F.lit(scale) * x.cast("double"))
    fine = F.forall(number, lambda x: (x >= -MOST) & (x < MOST + 1))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(number, lambda x: F.floor(x).cast("int")))


def _nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the lowest of equally near ones, and its squared distance."""
    apart = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = vectors - c
        apart[:, k] = np.einsum("ij,ij->i", d, d)
    best = apart.argmin(axis=1)
    return best, apart[np.arange(len(vectors)), best]


def _matrix(column: pd.Series, size: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.empty((0, size), np.int64)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 of ``<seed>:<vec_id>``, in that order."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    rows = hashed.where("h is not null").orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of what is assigned; empty ones stay."""
    k, size = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x = _matrix(b["q"], size)
            best, _ = _nearest(x, shared.value)
            for c in np.unique(best):
                sums[c] += x[best == c].sum(axis=0)
            counts += np.bincount(best, minlength=k)
        full = np.flatnonzero(counts)
        yield pd.DataFrame(
            {
                "cluster": np.repeat(full, size),
                "place": np.tile(np.arange(size), len(full)),
                "total": sums[full].ravel(),
                "n": np.repeat(counts[full], size),
            }
        )

    part = vectors.select("q").mapInPandas(run, "cluster int, place int, total long, n long")
    wide = part.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in wide.collect():  # k * size rows at most
        out[r.cluster, r.place] = int(r.total) // r.n
    shared.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    size = centroids.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best, distance = _nearest(_matrix(b["q"], size), shared.value)
            yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": best, "distance": distance})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "q").mapInPandas(run, f"vec_id {kind}, cluster int, distance long")


def centroid_clusters(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    size: int = SIZE,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` and the centroids.

    Vectors of another length than ``size``, null ones, and those with a null, NaN or infinite
    component, or one beyond ``MOST`` / ``SCALE`` (whose squared distances overflow), are left
    out.  Repeated rows count and are returned each time; rows with a null id are clustered but
    never start a centroid.  Equal distances go to the lower number.  With fewer than ``k``
    vectors there are as many centroids; an empty table gives no rows.  Other columns are not
    looked at.
    """
    spark = embeddings.sparkSession
    kept = embeddings.where(F.size(vector_col) == size).select(F.col(id_col).alias("vec_id"), integer_vector(F.col(vector_col)).alias("q"))
    vectors = stage(kept.where("q is not null"), "lloyd-vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):  # nothing to cluster, or no row with an id to start from
        columns = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, {columns}"), np.empty((0, size), np.int64)
    for _ in range(rounds):
        now = moved(vectors, centroids)
        still = np.array_equal(now, centroids)
        centroids = now
        if still:  # further rounds change nothing
            break
    out = stage(assigned(vectors, centroids), "lloyd-assigned")
    drop_stage(vectors)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(exact.alias("s")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    name = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    whole = fits(sum(sums.values()))
    rows = [(c, fits(s), whole, name(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", *facts.columns[1:]), centroids


def op12_lloyd(spark, sf_dir: str) -> DataFrame:
    """Every whole vector of ``embeddings`` with its cluster; what is left out and how ties fall
    is in ``centroid_clusters``.  A sum beyond a long is null."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))[0]


def _lloyd_sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same rounds as SQL: one set of common table expressions for each."""
    steps = [
        f"""v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q FROM (
        SELECT sha256('{SEED}:' || vec_id) AS h, q FROM v ORDER BY h LIMIT {k})
)""",
    ]
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
    SELECT vec_id, q, cluster, distance FROM (
        SELECT v.vec_id, v.q, c.cluster, {distance}::BIGINT AS distance FROM v CROSS JOIN c{r} c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)"""
        )
        if r < rounds:
            floor = "((s - (((s % n) + n) % n)) // n)::BIGINT"
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN (
        SELECT cluster, list({floor} ORDER BY place) AS q FROM (
            SELECT cluster, place, sum(x) AS s, count(*) AS n FROM (
                SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS place FROM a{r}) GROUP BY cluster, place)
        GROUP BY cluster) m USING (cluster)
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.cluster::INTEGER AS cluster, distance,
       (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.cluster = c.cluster"""


OP12_SQL = _lloyd_sql()
