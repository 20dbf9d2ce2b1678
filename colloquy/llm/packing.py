"""Best-fit packing of token pieces by exact-complement hashing over the length histogram."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import stage, table
from colloquy.llm.tokens import part, slices, tokenizer, vocabulary_path

END_ID = 0
CAPACITY = 2048
#: Pieces a block of the rank count has on average.
BLOCK_ROWS = 5000


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many such bins) for ``counts[length]`` pieces of each length.

    Longest pieces open bins.  A gap is looked up among single lengths, then pair sums, then
    triple sums of what is left, and every combination that fills it exactly is consumed as
    often as availability allows.  What finds no exact complement goes by best fit.  Each
    consumption uses up some length or all openers, so the plan's size depends on the
    capacity alone, never on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    bins: list[tuple[tuple[int, ...], int]] = []
    loose: list[tuple[int, int]] = []
    pair_ok = np.ones(capacity + 1, bool)  # sums not yet known to lack a pair

    def take(opener: int, rest: tuple[int, ...]) -> bool:
        need = np.bincount((opener, *rest), minlength=1)
        used = np.flatnonzero(need)
        m = int((left[used] // need[used]).min())
        if m:
            left[used] -= m * need[used]
            bins.append(((opener, *rest), m))
        return m > 0

    def pairs(total: int) -> np.ndarray:
        a = np.arange(total - 1, (total - 1) // 2, -1)
        a = a[a >= total - a]
        return a[(left[a] > 0) & (left[total - a] > 0) & ((a != total - a) | (left[a] > 1))]

    for opener in range(capacity, 0, -1):
        gap = capacity - opener
        if gap == 0:
            if left[opener]:
                bins.append(((opener,), int(left[opener])))
                left[opener] = 0
            continue
        if left[opener]:
            take(opener, (gap,))
        if left[opener] and gap >= 2:
            for a in pairs(gap):
                if not left[opener]:
                    break
                take(opener, (int(a), int(gap - a)))
        if left[opener] and gap >= 3:
            for a in range(gap - 2, 0, -1):
                if not left[opener]:
                    break
                if not left[a] or not pair_ok[gap - a]:
                    continue
                options = pairs(gap - a)
                pair_ok[gap - a] = len(options) > 0
                for b in options:
                    if not left[opener] or not left[a]:
                        break
                    take(opener, (a, int(b), int(gap - a - b)))
        if left[opener]:
            loose.append((opener, int(left[opener])))
            left[opener] = 0
    # best fit, longest first: into the smallest gap that holds the piece
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in loose:
        gap = length
        while n:
            while gap < capacity and not open_bins.get(gap):
                gap += 1
            if gap >= capacity:
                fit = capacity // length
                whole, rest = divmod(n, fit)
                for size, m in ((fit, whole), (rest, 1)):
                    if size and m:
                        open_bins.setdefault(capacity - size * length, []).append(((length,) * size, m))
                break
            held, m = open_bins[gap].pop()
            k = min(m, n)
            if m > k:
                open_bins[gap].append((held, m - k))
            open_bins.setdefault(gap - length, []).append(((*held, length), k))
            n -= k
    return bins + [x for some in open_bins.values() for x in some]


def slot_table(bins: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks and where they go: ``key = length << 40 | first rank``."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for lengths, m in bins:
        at = 0
        for length in lengths:
            rank = taken.get(length, 0)
            rows.append(((length << 40) | rank, base, at))
            taken[length] = rank + m
            at += length
        base += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 3).T
    return {"key": cols[0].copy(), "sequence": cols[1].copy(), "offset": cols[2].copy()}


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: each document's ids and end id, cut to fit.

    Null and empty texts have the end id alone.  Only longer documents are cut; all their
    pieces but the first are full.  Repeated rows give their pieces each time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, counts = tok.encode(part(b.column(1), lo, hi))
                ends = np.cumsum(counts)
                rows = {k: [] for k in ("row", "piece", "start", "length", "crc")}
                for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
                    own = np.append(ids[end - n : end], end_id).astype("<u4")
                    first = len(own) % capacity or capacity
                    cuts = [0, *range(first, len(own) + 1, capacity)]
                    for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        for name, v in zip(rows, (lo + k, p, x, y - x, zlib.crc32(own[x:y].tobytes())), strict=True):
                            rows[name].append(v)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows["row"], pa.int64())),
                        pa.array(rows["piece"], pa.int32()),
                        *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "crc")),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def ranked_by_length(pieces: DataFrame, n: int) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within each length, without gathering a length in one task."""
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, n // BLOCK_ROWS)))
    p = pieces.withColumn("_block", block)
    sizes = p.groupBy("length", "_block").count()
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block", "length").orderBy("doc_id", "piece", "ids_crc32")
    p = p.withColumn("_within", F.row_number().over(within) - 1)
    return p.join(sizes, ["_block", "length"]).withColumn("rank", F.col("_before") + F.col("_within"))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every piece.

    The driver sees the histogram of lengths only (``capacity`` rows at most).  Repeated rows
    are packed as separate pieces.  No pieces: no rows.
    """
    hist = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in hist.items():
        counts[length] = n
    slots = slot_table(plan_bins(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        want = (length.to_numpy(np.int64) << 40) | rank.to_numpy(np.int64)
        at = np.searchsorted(slots["key"], want, "right") - 1
        return pd.DataFrame({"sequence_id": slots["sequence"][at] + want - slots["key"][at], "offset": slots["offset"][at]})

    ranked = ranked_by_length(pieces, int(counts.sum()))
    return ranked.withColumn("_place", place("length", "rank")).select(*pieces.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize once into a table of piece lengths and checksums, then pack it."""
    pieces = stage(token_pieces(docs, vocabulary or vocabulary_path(), capacity, end_id), "pieces")
    return pack(pieces, capacity)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; nulls, empty, long and repeated
    texts as in ``pack_documents`` and ``token_pieces``."""
    return pack_documents(table(spark, sf_dir, "documents"))
