"""Near copies of a corpus: SimHash codes meet within a wide radius, exact Jaccard decides.

Codes within the radius agree on all but ``RADIUS`` of the bands, so any two meet under some
key, and the BK-tree of a key's shard, which goes to its own task, finds them.  A first pass finds links that span the candidates, under a few choices of bands and then,
between the clusters found so far, under all; it verifies one link a document, which contracts
dense clusters.  In rounds each code that may be apart from a near copy then asks for the one
of another cluster whose sketch is nearest, one verified link a code, so that a dense group is
joined without its pairs.  A last pass finds every pair that is still apart and verifies it.
A pair is told under the first choice of bands under which it meets, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import stage
from colloquy.llm.components import connected_components
from colloquy.llm.simhash import BITS, SEED, _signed, fingerprint

#: Words of a shingle and the least Jaccard similarity (5 / 4 of it is 1) of near copies.
WORDS = 5
#: Codes are of 3-word shingles.  Of the 48 (sf0.1) and 5 (sf0.01) pairs of texts of 50 words
#: or more with similarity 0.8, 48 and 5 are within 12 bits; of 5-word codes 42 and 5.
CODE_WORDS = 3
RADIUS = 12
BANDS = 14
#: Choices of bands under which codes meet, and those of them, without a band in common, under
#: which most of a dense cluster meets: links are of one forest a choice.
CHOICES = list(combinations(range(BANDS), BANDS - RADIUS))
FIRST_CHOICES = [c for c in CHOICES if c[0] % 2 == 0 and c[1] == c[0] + 1]
#: Codes held at once; a larger shard is cut into parts and every pair of parts searched.
SHARD_ROWS = 16_384
#: Buckets of the sketch of a shingle set, a multiple of 64.
SKETCH_BITS = 512
#: Codes that a BK-tree keeps in one leaf.
LEAF = 128
#: Distances taken at once.
BLOCK = 1 << 19
#: Pairs that a task tells at once.
TOLD = 1 << 17
#: Rounds of asking end when fewer than one in so many asked links is verified.
ROUND_GAIN = 4


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    runs = [b" ".join(words[k : k + WORDS]) for k in range(max(len(words) - WORDS + 1, 1))] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], np.uint64))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets is 0.8 or more."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 5 * both >= 4 * (len(x) + len(y) - both)


def sketch(own: np.ndarray) -> np.ndarray:
    """Whether the number of shingles in each of ``SKETCH_BITS`` buckets is odd, as bits in longs."""
    odd = np.bincount((own % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_CUTS = [BITS * k // BANDS for k in range(BANDS + 1)]


@cache
def _first_choices(choices: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """By the bits of the bands that agree, the number of the first choice that is among them."""
    masks = np.arange(1 << BANDS)
    out = np.full(1 << BANDS, len(choices), np.int16)
    for number in range(len(choices) - 1, -1, -1):
        bits = sum(1 << k for k in choices[number])
        out[masks & bits == bits] = number
    return out


def first_met(x: np.ndarray, y: np.ndarray, number: int, choices: tuple[tuple[int, ...], ...]) -> np.ndarray:
    """Which pairs of codes meet under this choice of bands and under none before it."""
    apart, agree = x ^ y, np.zeros(len(x), np.int64)
    for k, (a, b) in enumerate(zip(_CUTS, _CUTS[1:], strict=False)):
        agree |= ((apart >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) == 0).astype(np.int64) << k
    return _first_choices(choices)[agree] == number


def may_be_similar(n: np.ndarray, sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs can reach 0.8: a bucket odd in one set only holds a shingle of one set only, and
    with 0.8 no more than a ninth of both sets' shingles are in one set only."""
    out, bits = np.empty(len(x), bool), sketches.view(np.uint64)
    for k in range(0, len(x), 1 << 16):
        a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
        out[k : k + (1 << 16)] = 9 * apart <= n[a] + n[b]
    return out


def bk_tree(codes: np.ndarray, rows: np.ndarray) -> tuple:
    """``(rows, pivot, children)``: a BK-tree of the codes at ``rows``; a leaf has no pivot.

    A node keeps the rows of its pivot's code, and a child for each distance from it.
    """
    if len(rows) <= LEAF:
        return rows, None, ()
    pivot = codes[rows[0]]
    far = np.bitwise_count(codes[rows] ^ pivot)
    return rows[far == 0], pivot, [(int(k), bk_tree(codes, rows[far == k])) for k in np.unique(far) if k]


def _meetings(tree: tuple, codes: np.ndarray, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of asked rows and of rows in the tree, in which all pairs within the radius meet: an
    edge is followed where its distance is within the radius of the asked code's."""
    todo = [(tree, asked)]
    while todo:
        (rows, pivot, children), asked = todo.pop()
        near = asked
        if pivot is not None:
            far = np.bitwise_count(codes[asked] ^ pivot).astype(np.int64)
            near = asked[far <= RADIUS]
            for k, child in children:
                some = asked[np.abs(far - k) <= RADIUS]
                if len(some):
                    todo.append((child, some))
        step = max(1, BLOCK // max(len(rows), 1))
        for k in range(0, len(near) if len(rows) else 0, step):
            yield near[k : k + step], rows


def _sides(codes, sides) -> list[tuple[tuple, np.ndarray]]:
    """Trees and the rows that ask them: all rows, or each side the other's tree."""
    every = np.arange(len(codes))
    if not sides.any():
        return [(bk_tree(codes, every), every)]
    return [(bk_tree(codes, every[sides == s]), every[sides == 3 - s]) for s in (1, 2)]


def _pairs(ids, codes, comps, sides, met=None, n=None, sketches=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius whose components differ, a block at a time.

    With ``met``, a choice's number and all choices, pairs that an earlier one tells are left
    out; with sketches, those that can't be similar.
    """
    tree, asked = _sides(codes, sides)[0]
    for q, r in _meetings(tree, codes, asked):
        x, y = np.nonzero(np.bitwise_count(codes[q][:, None] ^ codes[r][None, :]) <= RADIUS)
        x, y = q[x], r[y]
        ok = (comps[x] != comps[y]) & (ids[x] != ids[y])
        if not sides.any():
            ok &= x < y
        x, y = x[ok], y[ok]
        if met:
            ok = first_met(codes[x], codes[y], *met)
            x, y = x[ok], y[ok]
        if sketches is not None:
            ok = may_be_similar(n, sketches, x, y)
            x, y = x[ok], y[ok]
        if len(x):
            yield x, y


def _nearest(ids, codes, comps, sides, met, n, sketches):
    """For each code one that may be similar and is of another component, the nearest by sketch
    of the first block that has any: positions of both, and how far apart for their sizes."""
    other, far, bits = np.full(len(codes), -1, np.int64), np.zeros(len(codes), np.int64), sketches.view(np.uint64)
    for tree, asked in _sides(codes, sides):
        for q, r in _meetings(tree, codes, asked):
            q = q[other[q] < 0]
            x, y = np.nonzero(np.bitwise_count(codes[q][:, None] ^ codes[r][None, :]) <= RADIUS)
            x, y = q[x], r[y]
            ok = (comps[x] != comps[y]) & (ids[x] != ids[y])
            x, y = x[ok], y[ok]
            ok = first_met(codes[x], codes[y], *met)
            x, y = x[ok], y[ok]
            for k in range(0, len(x), 1 << 16):
                a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                apart, both = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64), n[a] + n[b]
                ok = np.flatnonzero(9 * apart <= both)
                a, b, apart = a[ok], b[ok], 1000 * apart[ok] // np.maximum(both[ok], 1)
                order = np.lexsort((apart, a))
                a, b, apart = a[order], b[order], apart[order]
                best = np.append(True, a[1:] != a[:-1])[: len(a)]
                a, b, apart = a[best], b[best], apart[best]
                better = (other[a] < 0) | (apart < far[a])
                other[a[better]], far[a[better]] = b[better], apart[better]
    asking = np.flatnonzero(other >= 0)
    return asking, other[asking], far[asking]


def _spanning(ids, codes, comps, sides, met=None):
    """Pairs within the radius that join whatever all such pairs join: all of them if they are no
    more than the codes, else a forest, fewer than the codes.

    The forest grows in rounds: each code asks for one within the radius that is in another
    tree of the forest, so the trees with such a neighbour at least halve.
    """
    told = [(np.zeros(0, np.int64),) * 2]
    for x, y in _pairs(ids, codes, comps, sides, met):
        told.append((x, y))
        if sum(len(x) for x, _ in told) > len(codes):
            break
    else:
        return tuple(map(np.concatenate, zip(*told, strict=True)))
    trees, up = _sides(codes, sides), list(range(len(codes)))

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    _, root = np.unique(comps, return_index=True)  # what is joined already is one tree
    at = root[np.searchsorted(comps[root], comps)]
    for k, r in enumerate(at.tolist()):
        up[k] = r
    left, right, alive = [], [], np.ones(len(codes), bool)
    while True:
        other = np.full(len(codes), -1, np.int64)
        for tree, asked in trees:
            for q, r in _meetings(tree, codes, asked[alive[asked]]):
                q = q[other[q] < 0]
                hit = (np.bitwise_count(codes[q][:, None] ^ codes[r][None, :]) <= RADIUS) & (at[q][:, None] != at[r][None, :])
                any_ = hit.any(axis=1)
                other[q[any_]] = r[hit[any_].argmax(axis=1)]
        asking = np.flatnonzero(other >= 0)
        if not len(asking):
            return np.array(left, np.int64), np.array(right, np.int64)
        # a code without a neighbour in another tree never gets one
        alive &= other >= 0
        for x, y in zip(asking.tolist(), other[asking].tolist(), strict=True):
            a, b = find(x), find(y)
            if a != b:
                up[max(a, b)] = min(a, b)
                left.append(x)
                right.append(y)
        at = np.array([find(k) for k in range(len(codes))])


def _keyed(codes: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """``codes(id, fp, comp)`` once under each choice of bands, ``g`` naming choice and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, choice in enumerate(choices):
                key = np.zeros(len(fp), np.uint64)
                for k in choice:
                    width = np.uint64(_CUTS[k + 1] - _CUTS[k])
                    key = (key << width) | ((fp >> np.uint64(_CUTS[k])) & ((np.uint64(1) << width) - np.uint64(1)))
                g = key.astype(np.int64) + (number << 40)
                yield pa.RecordBatch.from_arrays([pa.array(g), *b.columns], ["g", "id", "fp", "comp", *more])

    more = [c for c in codes.columns if c not in ("id", "fp", "comp")]
    return codes.select("id", "fp", "comp", *more).mapInArrow(run, ", ".join(f"{c} long" for c in ("g", "id", "fp", "comp", *more)))


def _shards(codes: DataFrame, shard_rows: int, choices: list[tuple[int, ...]]) -> DataFrame:
    """Codes by shard, or by pair of parts of a large one, each in one task and together."""
    more = [c for c in codes.columns if c not in ("id", "fp", "comp")]
    keyed = _keyed(codes, choices)
    big = keyed.groupBy("g").count().where(F.col("count") > shard_rows)
    parts = keyed.join(F.broadcast(big), "g", "left").withColumn(
        "parts", F.coalesce(F.ceil(F.col("count") / F.lit(shard_rows)), F.lit(1)).cast("int")
    )
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    placed = placed.select("g", i.alias("i"), j.alias("j"), side.cast("long").alias("side"), "id", "fp", "comp", *more)
    spark = codes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), codes.count() // 20_000)
    return placed.repartition(tasks, "g", "i", "j").sortWithinPartitions("g", "i", "j")


def _each_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The columns of one shard of two rows or more after the other."""
    held = None
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns])
        held = rows if held is None else np.concatenate([held, rows], axis=1)
        ends, at = np.flatnonzero((np.diff(held[:3], axis=1) != 0).any(axis=0)) + 1, 0
        for end in ends.tolist():
            if end - at > 1:
                yield held[:, at:end]
            at = end
        held = held[:, at:].copy()
    if held is not None and held.shape[1] > 1:
        yield held


def _told(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of longs as batches of about ``TOLD`` rows."""
    held, n = [], 0

    def batch():
        columns = zip(*held, strict=True) if held else [[np.zeros(0, np.int64)]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], names)

    for columns in found:
        held.append(columns)
        n += len(columns[0])
        if n >= TOLD:
            yield batch()
            held, n = [], 0
    yield batch()


def near_pairs(
    codes: DataFrame, spanning: bool, shard_rows: int = SHARD_ROWS, choices: list[tuple[int, ...]] = CHOICES
) -> DataFrame:
    """``codes(id, fp, comp[, n, s0, s1 ..])`` -> ``(a, b)``, a > b, once each: pairs of different
    ``comp`` within the radius, all of them or as many as join, with ``comp``, what all join.
    With sketches, all but those that can't be similar; with fewer ``choices``, those that meet."""
    sketched, every = len(codes.columns) > 3, tuple(choices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for rows in _each_shard(batches):
                ids, fps, comps, sides, met = rows[4], rows[5].view(np.uint64), rows[6], rows[3], (int(rows[0, 0] >> 40), every)
                if spanning:
                    blocks = [_spanning(ids, fps, comps, sides, met)]
                else:
                    sketches = np.ascontiguousarray(rows[8:].T) if sketched else None
                    blocks = _pairs(ids, fps, comps, sides, met, rows[7] if sketched else None, sketches)
                for x, y in blocks:
                    yield np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])

        yield from _told(found(), ["a", "b"])

    return _shards(codes, shard_rows, choices).mapInArrow(run, "a long, b long").distinct()


def asked_pairs(codes: DataFrame, shard_rows: int = SHARD_ROWS, choices: list[tuple[int, ...]] = CHOICES) -> DataFrame:
    """``codes(id, fp, comp, n, s0, s1 ..)`` -> ``(a, b)``, a > b, once each: for every code that
    may have a similar one of another ``comp`` within the radius, the nearest by sketch of those
    that its shards name.  No more pairs than codes."""
    every = tuple(choices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for rows in _each_shard(batches):
                met, sketches = (int(rows[0, 0] >> 40), every), np.ascontiguousarray(rows[8:].T)
                x, y, far = _nearest(rows[4], rows[5].view(np.uint64), rows[6], rows[3], met, rows[7], sketches)
                yield rows[4][x], rows[4][y], far

        yield from _told(found(), ["x", "y", "far"])

    asked = _shards(codes, shard_rows, choices).mapInArrow(run, "x long, y long, far long")
    one = asked.groupBy("x").agg(F.min(F.struct("far", "y")).alias("to")).select("x", F.col("to.y").alias("y"))
    return one.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b)`` whose texts (``id, t``) are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    left = texts.select(F.col("id").alias("a"), F.col("t").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("t").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _joined(rest: DataFrame, links: DataFrame) -> DataFrame:
    """``rest`` with ``comp`` joined by these links, without those of groups that are now one."""
    comp = lambda end: rest.select(F.col("id").alias(end), F.col("comp").alias(f"_{end}"))
    between = links.join(comp("a"), "a").join(comp("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    met = connected_components(between).withColumnRenamed("node", "comp")
    new = rest.join(met, "comp", "left").withColumn("comp", F.coalesce("component", "comp")).select(*rest.columns)
    apart = new.groupBy("wide").agg((F.min("comp") < F.max("comp")).alias("apart")).where("apart")
    return new.join(apart, "wide", "left_semi")


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id)``: the smallest id of each component of near copies; null ids are not looked at.

    Texts of equal shingle sets are one class.  Links are pairs of Jaccard similarity 0.8 or
    more among those within the radius.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets, parts = [], [], []
            for x in b.column(1):  # a text's shingles at a time
                text = x.as_py()
                own = shingles(text)
                fps.append(_signed(fingerprint(text, CODE_WORDS)))
                sets.append(xxhash.xxh3_128_digest(own.tobytes()))
                parts.append([len(own), *sketch(own)])
            parts = np.array(parts, np.int64).reshape(-1, len(extra)).T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(sets, pa.binary()), *map(pa.array, parts)], ["id", "fp", "set", *extra])

    extra = ["n", *(f"s{k}" for k in range(SKETCH_BITS // 64))]
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    coded = texts.mapInArrow(run, "id long, fp long, set binary, " + ", ".join(f"{c} long" for c in extra))
    # equal sets have equal sketches, and of their codes the one of the smallest id counts
    classes = stage(coded.groupBy("set").agg(F.min("id").alias("id"), F.min_by("fp", "id").alias("fp"), *(F.min(c).alias(c) for c in extra)), "near-classes")
    codes = classes.select("id", "fp", F.col("id").alias("comp"))
    first = stage(near_pairs(codes, True, choices=FIRST_CHOICES), "near-first")
    met = connected_components(first).withColumnRenamed("node", "id")
    codes = stage(codes.join(met, "id", "left").select("id", "fp", F.coalesce("component", "id").alias("comp")), "near-met")
    spans = stage(first.unionByName(near_pairs(codes, True)), "near-spans")
    links = stage(verified(spans.groupBy("a").agg(F.min("b").alias("b")), texts).distinct(), "near-links")

    def ids_to(roots: DataFrame, end: str) -> DataFrame:
        return roots.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))

    roots = connected_components(links)
    both = spans.join(ids_to(roots, "a"), "a", "left").join(ids_to(roots, "b"), "b", "left")
    apart = both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select(F.col("a").alias("node"))
    wide = connected_components(spans)
    active = apart.join(wide, "node").select("component").distinct().join(wide, "component").select(F.col("node").alias("id"), F.col("component").alias("wide"))
    rest = stage(
        classes.drop("set").join(active, "id").join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("wide", "id", "fp", F.coalesce("component", "id").alias("comp"), *extra),
        "near-rest",
    )
    some = stage(texts.join(rest.select("id"), "id", "left_semi"), "near-texts")
    while True:
        asked = stage(asked_pairs(rest.drop("wide")), "near-asked")
        new = stage(verified(asked, some).distinct(), "near-answered")
        links = links.unionByName(new)
        gain, cost = new.count(), asked.count()
        if gain:
            rest = stage(_joined(rest, new), "near-rest")
        if ROUND_GAIN * gain < cost or not cost:
            break
    more = stage(verified(near_pairs(rest.drop("wide"), False), some).distinct(), "near-more")
    later = connected_components(links.unionByName(more)).where("node <> component").select(F.col("node").alias("id"))
    return classes.select("id").distinct().join(later, "id", "left_anti").select(F.col("id").alias("doc_id"))
