"""SimHash fingerprints and near-duplicate linking through BK-trees.

A BK-tree keys each child by its integer Hamming distance to the parent, so a search with
radius r follows only the edges whose key lies within r of the query's distance.  One tree
over all fingerprints would have to be broadcast whole, and would grow with the corpus; here
the fingerprints are first dealt to shards in which any two within the radius must meet
(they agree on all but ``radius`` of the bands), and each shard's tree goes to its own task
together with that shard's queries.  Trees hold at most ``shard_rows`` fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stage
from colloquy.llm.components import connected_components

SEED = 42
BITS = 64


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles; no words: 0."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), len(tokens)
    if n < words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64
        )
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint's bits as a signed long.

    Null and empty texts, and texts of white space only, have fingerprint 0.  Repeated rows
    give repeated rows; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


class BKTree:
    """Children keyed by integer Hamming distance to the parent; equal codes are one node."""

    __slots__ = ("root",)

    def __init__(self, codes=()):
        self.root = None
        for c in codes:
            self.add(c)

    def add(self, code: int) -> None:
        if self.root is None:
            self.root = (code, {})
            return
        node = self.root
        while d := (node[0] ^ code).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = (code, {})
                return
            node = child

    def within(self, code: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            own, children = todo.pop()
            d = (own ^ code).bit_count()
            if d <= radius:
                found.append(own)
            if children:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
        return found


def _links_of_shard(tree_side: list[tuple[int, int]], query_side: list[tuple[int, int]], radius: int, own: bool) -> list[tuple[int, int]]:
    """A spanning set of the links between the two sides (ids), from codes of one shard."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    ids = {code: i for i, code in tree_side}
    tree = BKTree() if own else BKTree(ids)
    out = []
    for i, code in query_side:
        for other in tree.within(code, radius):
            a, b = find(i), find(ids[other])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, ids[other]))
        if own:
            tree.add(code)
    return out


def bands_for(n: int) -> int:
    """Bands so that a shard key has about as many values as there are fingerprints."""
    return 4 if n < 1 << 21 else 5 if n < 1 << 29 else 6


def shard_keys(code, bands: int, radius: int):
    """Columns for each choice of ``bands - radius`` bands: codes within the radius agree on one."""
    cuts = [BITS * k // bands for k in range(bands + 1)]
    keys = []
    for choice in combinations(range(bands), bands - radius):
        key = F.lit(0).cast("long")
        for k in choice:
            width = cuts[k + 1] - cuts[k]
            part = F.shiftrightunsigned(code, cuts[k]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key)
    return keys


def near_links(codes: DataFrame, radius: int = 3, shard_rows: int = 2000) -> DataFrame:
    """``codes(id, fp)`` with distinct fp -> ``(a, b)``: links whose components are those of all links.

    A shard key that more than ``shard_rows`` codes share is cut into equal parts by hash, and
    every pair of parts is searched, so a dense cluster needs more tasks, not more memory.
    """
    codes = codes.select("id", "fp")
    n = codes.count()
    keys = shard_keys(F.col("fp"), bands_for(n), radius)
    dealt = codes.select("id", "fp", F.posexplode(F.array(*keys)).alias("choice", "key"))
    sizes = dealt.groupBy("choice", "key").count().where("count > 1")
    parts = dealt.join(sizes, ["choice", "key"]).withColumn(
        "parts", F.ceil(F.col("count") / F.lit(shard_rows)).cast("int")
    )
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    placed = (
        parts.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "choice", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "fp"
        )
    )
    group = ["choice", "key", "i", "j"]
    spark = codes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def flush():
            i, j = at[2], at[3]
            tree = [(r[1], r[2]) for r in held if r[0] == i]
            return _links_of_shard(tree, tree if i == j else [(r[1], r[2]) for r in held if r[0] == j], radius, i == j)

        for b in batches:
            found = []
            c = [b.column(k).to_pylist() for k in range(7)]
            for k in zip(*c, strict=True):
                if k[:4] != at:
                    if len(held) > 1:
                        found += flush()
                    held, at = [], k[:4]
                held.append((k[4], k[5], k[6] & 0xFFFFFFFFFFFFFFFF))
            yield _edge_batch(found)
        if len(held) > 1:
            yield _edge_batch(flush())

    return (
        placed.repartition(tasks, *group)
        .sortWithinPartitions(*group)
        .select(*group, "own", "id", "fp")
        .mapInArrow(run, "a long, b long")
    )


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"]
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3
) -> DataFrame:
    """``(doc_id, fp, component_id)``: documents linked at ``radius`` or fewer differing bits.

    component_id is the smallest doc_id reachable, the row's own included.  Equal
    fingerprints are one class and are never paired with each other.  Rows with a null id
    take the component of their class (null if no row of the component has an id).
    Empty table: no rows.
    """
    fps = stage(simhash(docs, id_col, text_col, words), "simhash")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-classes")
    links = near_links(classes.where("id is not null"), radius)
    roots = connected_components(links)
    comp = classes.join(roots, F.col("id") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )
    return fps.join(comp, "fp", "left").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every document; nulls, empty and repeated texts as
    in ``simhash`` and ``simhash_components``."""
    from colloquy.llm.common import table

    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
