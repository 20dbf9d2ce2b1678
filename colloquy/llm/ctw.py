"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, the 255 nodes of a binary tree; each node has a context
tree of its own over the whole preceding bytes.  In every context a Krichevsky-Trofimov
estimator predicts the bit, and context-tree weighting mixes the estimates of all depths from
none to ``DEPTH``, which gives a code length for each byte.

Documents lie in blocks.  A block's distinct keys (``DEPTH`` preceding bytes and the byte) go
with their training counts to buckets that hold whole subtrees below two bytes.  Buckets add
the counts up, weigh their subtrees and answer each block's keys; only the nodes of depth 1
and 0 pass through the driver, a fixed number.  Words for the base score travel the same way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.answers import ANSWER, Answers, answers_by_part, grouped, record_batch
from colloquy.llm.common import drop_folder, drop_stage, fresh_path, stage, table
from colloquy.llm.shared_files import make_folder
from colloquy.llm.tokens import part, slices
from colloquy.llm.toxicity import held_out

#: Preceding bytes of a full context, and those that a bucket's subtrees share.
DEPTH, ROUTED = 5, 2
#: What stands before a text, and the symbol that ends it.
BEFORE, END = 10, 0
#: Bytes of text in a block, about.
BLOCK_BYTES = 4 << 20
#: Buckets of contexts and of words.
BUCKET_BITS, WORD_BUCKETS = 9, 256
#: Costs of a byte travel in steps of 1/1024 bit, 64 bits at most (2^-64 needs counts of 2^60).
STEP = 1024.0
HELD_FOLD = 1
_LOW = 8 * (DEPTH - ROUTED + 1)
#: An odd multiplier deals the two routed bytes evenly over the buckets, and its inverse.
_DEAL = 40503
_BACK = pow(_DEAL, -1, 1 << 16)


def routed_key(raw: np.ndarray) -> np.ndarray:
    """Key of each byte of ``raw`` from the ``DEPTH``-th on.

    From the top: the two bytes before it (dealt), the other preceding bytes, nearest first,
    and the byte itself.  Keys in order lie bucket by bucket, subtree by subtree.
    """
    n = len(raw) - DEPTH
    near = raw[DEPTH - 1 : -1].astype(np.uint32) << np.uint32(8) | raw[DEPTH - 2 : -2]
    key = ((near * np.uint32(_DEAL)) & np.uint32(0xFFFF)).astype(np.uint64) << np.uint64(_LOW)
    low = np.zeros(n, np.uint32)
    for k in range(ROUTED + 1, DEPTH + 1):
        low |= raw[DEPTH - k : len(raw) - k].astype(np.uint32) << np.uint32(8 * (DEPTH - k + 1))
    low |= raw[DEPTH:]
    return key | low


def last_byte(key: np.ndarray) -> np.ndarray:
    """The byte just before, from keys or from their two dealt bytes."""
    top = (key >> np.uint64(_LOW)).astype(np.uint32)
    return ((top * np.uint32(_BACK)) & np.uint32(0xFFFF)) >> np.uint32(8)


def bucket_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(_LOW + 16 - BUCKET_BITS)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Unsigned values as planes of bytes, which compress well where high bytes are zero."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, np.int64)


# ---- blocks


class Block:
    """A run of documents: ids, which are learnt from, sizes in bytes and all bytes."""

    def __init__(self, number: int, doc_ids: pa.Array, train: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.number, self.doc_ids, self.train, self.sizes, self.data = number, doc_ids, train, sizes, data

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the rank of each byte's key (ends included), bytes of each text."""
        n, m = len(self.sizes), DEPTH + 1
        raw = np.full(len(self.data) + n * m + DEPTH, BEFORE, np.uint8)
        to = np.repeat(np.arange(1, n + 1) * m - 1, self.sizes) + np.arange(len(self.data))
        raw[to] = self.data
        ends = np.cumsum(self.sizes) + np.arange(1, n + 1) * m - 1
        raw[ends] = END
        raw = raw[: len(self.data) + n * m]
        real = np.ones(len(raw), bool)
        real[((np.cumsum(self.sizes) - self.sizes + np.arange(n) * m)[:, None] + np.arange(DEPTH)).ravel()] = False
        key = routed_key(raw)[real[DEPTH:]] if n else np.zeros(0, np.uint64)
        coded = pa.array(key).dictionary_encode()
        distinct = coded.dictionary.to_numpy()
        order = np.argsort(distinct)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        return distinct[order], rank[coded.indices.to_numpy()], self.sizes + 1

    def words(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct lower-case words in order of their hash bucket, the code of each word, words of each text."""
        offsets = np.append(0, np.cumsum(self.sizes)).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(self.sizes), pa.py_buffer(offsets), pa.py_buffer(self.data))
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words, at = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        upto = np.append(0, np.cumsum(real))
        coded = words.filter(pa.array(real)).dictionary_encode()
        return coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy(), np.diff(upto[at - at[0]])


_BLOCK = "part long, block long, doc_ids array<long>, train array<boolean>, sizes array<long>, data binary"


def pack_blocks(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, t, train)`` as blocks of about ``BLOCK_BYTES``; a longer text is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        block = at << 32
        for b in batches:
            for lo, hi in slices(b.column(1), BLOCK_BYTES):
                texts = pc.fill_null(part(b.column(1), lo, hi), b"")
                sizes = pc.binary_length(texts).cast(pa.int64())
                own = [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), sizes]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at]), pa.array([block]), *(pa.ListArray.from_arrays([0, hi - lo], x) for x in own), pa.array([b"".join(texts.to_pylist())], pa.binary())],
                    ["part", "block", "doc_ids", "train", "sizes", "data"],
                )
                block += 1

    return rows.mapInArrow(run, _BLOCK)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            ids, train, sizes = (b.column(c)[k].values for c in ("doc_ids", "train", "sizes"))
            data = b.column("data")[k].as_buffer()
            yield Block(b.column("block")[k].as_py(), ids, train.to_numpy(zero_copy_only=False).astype(bool), sizes.to_numpy(), np.frombuffer(data, np.uint8))


# ---- contexts: rows to buckets


def context_rows(blocks: DataFrame) -> DataFrame:
    """``(bucket, block, keys, counts)``: a block's distinct keys and training counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            keys, rank, sizes = b.keys()
            n = np.bincount(rank[np.repeat(b.train, sizes)], minlength=len(keys)).astype(np.uint32)
            of = bucket_of(keys)
            at = _cuts(of)
            rows = [
                (int(of[x]), b.number, packed(np.diff(keys[x:y], prepend=np.uint64(0))), packed(n[x:y]))
                for x, y in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)
            ]
            if rows:
                yield record_batch(rows, ["bucket", "block", "keys", "counts"], keys=pa.binary(), counts=pa.binary())

    return blocks.mapInArrow(run, "bucket long, block long, keys binary, counts binary")


def keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    at = _cuts(k)
    return k[at], np.add.reduceat(n[order], at) if len(k) else n


class Fold:
    """Adds up the keys of rows as they come, holding the distinct ones and a bounded rest."""

    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held += len(keys)
        if self.held > max(1_000_000, 2 * len(self.keys[0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        k, n = added(self.keys, self.counts) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.keys, self.counts, self.held = [k], [n], len(k)
        return k, n


# ---- context-tree weighting


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5 by Stirling's series after a shift of eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    s = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + s - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any order of n0 zeros, n1 ones."""
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes and the share that their own estimate keeps.

    ``below`` is the sum of the log weighted probabilities of a node's children, None at full
    depth, where the own estimate is all there is.
    """
    own = kt_log(n0, n1)
    if below is None:
        return own, np.ones_like(own)
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


class Level:
    """The binary nodes of one level of the byte's tree in all contexts of one depth.

    ``pairs`` are sorted (context, byte) pairs with counts; a node is a context and the
    byte's first ``bits`` bits.
    """

    def __init__(self, pairs: np.ndarray, n: np.ndarray, bits: int):
        node = pairs >> np.uint64(8 - bits)
        self.first = _cuts(node)
        self.of = np.cumsum(np.bincount(self.first, minlength=len(pairs))) - 1
        one = (pairs >> np.uint64(7 - bits)) & np.uint64(1)
        self.n1 = np.add.reduceat(np.where(one == 1, n, 0), self.first).astype(float)
        self.n0 = np.add.reduceat(n, self.first) - self.n1


def subtrees(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Predictions below ``ROUTED`` bytes for whole subtrees of sorted distinct keys.

    Gives, for each key and bit of its byte, the probability of that bit as mixed over the
    depths from ``ROUTED`` on, and rows (last byte, node, zeros, ones, log weighted
    probability) of the nodes at depth ``ROUTED``.
    """
    pairs, counts, up = {DEPTH: keys}, {DEPTH: n}, {}
    for d in range(DEPTH - 1, ROUTED - 1, -1):
        short = (pairs[d + 1] >> np.uint64(16) << np.uint64(8)) | (pairs[d + 1] & np.uint64(0xFF))
        pairs[d], up[d + 1] = np.unique(short, return_inverse=True)
        counts[d] = np.bincount(up[d + 1], counts[d + 1], len(pairs[d])).astype(np.int64)
    taken = np.empty((len(keys), 8))
    top = []
    for bits in range(8):
        levels = {d: Level(pairs[d], counts[d], bits) for d in pairs}
        # node of a deeper level -> node of the level above, by their first pairs
        parent = {d: levels[d - 1].of[up[d][levels[d].first]] for d in range(ROUTED + 1, DEPTH + 1)}
        log_w, stay = {}, {}
        for d in range(DEPTH, ROUTED - 1, -1):
            x = levels[d]
            below = np.bincount(parent[d + 1], log_w[d + 1], len(x.n0)) if d < DEPTH else None
            log_w[d], stay[d] = weigh(x.n0, x.n1, below)
        x = levels[ROUTED]
        context = pairs[ROUTED][x.first] >> np.uint64(8)
        node = (1 << bits) + ((pairs[ROUTED][x.first] & np.uint64(0xFF)) >> np.uint64(8 - bits)).astype(np.int64)
        top.append((last_byte(context << np.uint64(_LOW)).astype(np.int64), node, x.n0, x.n1, log_w[ROUTED]))
        for bit in (0, 1):
            rest, mixed = np.ones(len(x.n0)), np.zeros(len(x.n0))
            for d in range(ROUTED, DEPTH + 1):
                y = levels[d]
                if d > ROUTED:
                    rest, mixed = rest[parent[d]], mixed[parent[d]]
                kt = ((y.n1 if bit else y.n0) + 0.5) / (y.n0 + y.n1 + 1.0)
                mixed, rest = mixed + rest * stay[d] * kt, rest * (1 - stay[d])
            hit = ((keys >> np.uint64(7 - bits)) & np.uint64(1)) == bit
            taken[hit, bits] = mixed[levels[DEPTH].of[hit]]
    return taken, top


class Root:
    """The nodes of depth 1 and 0, from rows (last byte, node, zeros, ones, log weighted)."""

    def __init__(self, rows):
        n0, n1, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
        for c, node, zeros, ones, w in rows:
            n0[c, node], n1[c, node], below[c, node] = zeros, ones, w
        w1, stay1 = weigh(n0, n1, below)
        a0, a1 = n0.sum(axis=0), n1.sum(axis=0)
        _, stay0 = weigh(a0, a1, np.where(n0 + n1 > 0, w1, 0).sum(axis=0))
        #: by bit, last byte and node: probability from depths 0 and 1, and what is left for deeper ones
        self.mixed = np.stack([
            stay0 * ((a + 0.5) / (a0 + a1 + 1)) + (1 - stay0) * stay1 * ((n + 0.5) / (n0 + n1 + 1)) for a, n in ((a0, n0), (a1, n1))
        ])
        self.rest = (1 - stay0) * (1 - stay1)

    def bits(self, keys: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Code length of each key's byte, from the predictions of its subtree."""
        last, byte = last_byte(keys), (keys & np.uint64(0xFF)).astype(np.int64)
        total = np.zeros(len(keys))
        for k in range(8):
            node, bit = (1 << k) + (byte >> (8 - k)), (byte >> (7 - k)) & 1
            total -= np.log2(self.mixed[bit, last, node] + self.rest[last, node] * taken[:, k])
        return total


_FOLDED = "bucket long, keys binary, counts binary"


def folded(rows: DataFrame) -> DataFrame:
    """Keys of ``(bucket, block, keys, counts)`` rows added up for each run of a bucket in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in grouped(batches):
            fold = Fold()
            for row in own:
                fold.add(keys_of(row[2]), unpacked(row[3], "<u4").astype(np.int64))
            k, n = fold.total()
            yield record_batch([(bucket, packed(np.diff(k, prepend=np.uint64(0))), packed(n.astype("<u8")))], ["bucket", "keys", "counts"], keys=pa.binary(), counts=pa.binary())

    return rows.mapInArrow(run, _FOLDED)


#: Keys whose subtrees are weighed at once, about.
_AT_ONCE = 500_000


def fit(rows: DataFrame, folder: str, tasks: int) -> Root:
    """Weigh all subtrees; each bucket's predictions become a file of ``folder``.

    A task folds the partial counts of a bucket and works on runs of whole two-byte subtrees,
    so it holds a bucket's distinct keys and one run's nodes.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        kind = pa.schema([("key", pa.uint64()), ("taken", pa.binary(32))])
        for bucket, own in grouped(batches):
            fold = Fold()
            for row in own:
                fold.add(keys_of(row[1]), unpacked(row[2], "<u8").astype(np.int64))
            keys, n = fold.total()
            at = _cuts(keys >> np.uint64(_LOW))
            at = at[np.append(0, np.flatnonzero(np.diff(at // _AT_ONCE)) + 1)]
            mine = f"{path}/.{bucket}-{uuid.uuid4().hex}"
            with pq.ParquetWriter(mine, kind, filesystem=where, compression="zstd") as out:
                for x, y in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True):
                    taken, top = subtrees(keys[x:y], n[x:y])
                    raw = pa.py_buffer(taken.astype("<f4").tobytes())
                    out.write_table(pa.table([pa.array(keys[x:y]), pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), y - x, [None, raw])], schema=kind))
                    c, node, n0, n1, w = (np.concatenate(v) for v in zip(*top, strict=True))
                    seen = n0 + n1 > 0
                    yield pa.RecordBatch.from_arrays([pa.array(v[seen]) for v in (c, node, n0, n1, w)], ["c", "node", "n0", "n1", "w"])
            where.move(mine, f"{path}/{bucket}.parquet")

    whole = folded(rows).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    sums = whole.mapInArrow(run, "c long, node long, n0 double, n1 double, w double").groupBy("c", "node").agg(*(F.sum(x).alias(x) for x in ("n0", "n1", "w")))
    return Root(sums.collect())


def context_answers(rows: DataFrame, folder: str, root: Root) -> DataFrame:
    """The cost of each key of each row, in the row's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        for bucket, own in grouped(batches):
            t = pq.read_table(f"{path}/{bucket}.parquet", filesystem=where)
            keys = t["key"].to_numpy()
            taken = np.frombuffer(b"".join(c.buffers()[1][c.offset * 32 : (c.offset + len(c)) * 32] for c in t["taken"].chunks), "<f4").reshape(-1, 8)
            cost = np.minimum(np.rint(root.bits(keys, taken) * STEP), 65535).astype("<u2")
            for row in own:
                payload = packed(cost[np.searchsorted(keys, keys_of(row[2]))])
                yield record_batch([(row[1] >> 32, row[1], bucket, payload)], ["part", "block", "bucket", "payload"], payload=pa.binary())

    return rows.select("bucket", "block", "keys").mapInArrow(run, ANSWER)


# ---- words of the base score


def _word_buckets(words: pa.Array) -> np.ndarray:
    """Bucket of each word, from its size, its first and last eight bytes and one in the middle."""
    flat = np.frombuffer(words.buffers()[2] or b"", np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(at)
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8):
        for place in (np.minimum(k, size - 1), np.maximum(size - 1 - k, 0)):
            h = (h ^ flat[at[:-1] + place]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h % np.uint64(WORD_BUCKETS)).astype(np.int64)


def _by_word_bucket(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct words by bucket, the buckets present and where each begins."""
    of = _word_buckets(words) if len(words) else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    at = _cuts(of[order])
    return order, of[order][at], np.append(at, len(of))


def word_rows(blocks: DataFrame) -> DataFrame:
    """``(bucket, block, words, counts)``: a block's distinct words and training counts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            words, codes, sizes = b.words()
            n = np.bincount(codes[np.repeat(b.train, sizes)], minlength=len(words)).astype(np.int64)
            order, found, at = _by_word_bucket(words)
            if len(found):
                own = words.take(pa.array(order)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(found), b.number)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), own), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(n[order]))],
                    ["bucket", "block", "words", "counts"],
                )

    return blocks.mapInArrow(run, "bucket long, block long, words array<string>, counts array<long>")


def vocabulary(rows: DataFrame) -> DataFrame:
    """``(bucket, word, c)`` of every training word."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        names = ["bucket", "word", "c"]
        n = 0
        for b in batches:
            bucket = pc.take(b.column(0), pc.list_parent_indices(b.column(1)))
            t = pa.table([bucket, b.column(1).flatten(), b.column(2).flatten()], names).filter(pc.field("c") > 0)
            held[len(held)] = t.group_by(["bucket", "word"]).aggregate([("c", "sum")]).rename_columns(names)
            n += held[len(held) - 1].num_rows
            if n > 500_000:
                t = pa.concat_tables(held.values()).group_by(["bucket", "word"]).aggregate([("c", "sum")]).rename_columns(names)
                held = {0: t}
                if t.num_rows > 250_000:
                    yield from t.to_batches()
                    held = {}
                n = sum(x.num_rows for x in held.values())
        if held:
            yield from pa.concat_tables(held.values()).group_by(["bucket", "word"]).aggregate([("c", "sum")]).rename_columns(names).to_batches()

    some = rows.select("bucket", "words", "counts").mapInArrow(partial, "bucket long, word string, c long")
    return some.groupBy("bucket", "word").agg(F.sum("c").alias("c"))


def word_answers(rows: DataFrame, vocab: DataFrame, tasks: int) -> DataFrame:
    """The training count of each word of each row, in the row's order."""
    known = vocab.groupBy("bucket").agg(F.collect_list("word").alias("known"), F.collect_list("c").alias("c"))
    first = known.select("bucket", F.lit(-1).cast("long").alias("block"), F.col("known").alias("words"), F.col("c").alias("counts"))
    both = rows.select("bucket", "block", "words", F.array().cast("array<long>").alias("counts")).unionByName(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, counts = None, pa.array([], pa.string()), np.zeros(0, np.int64)
        for b in batches:
            for k in range(b.num_rows):
                bucket, block, words = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].values
                if bucket != at:
                    at, names, counts = bucket, pa.array([], pa.string()), np.zeros(0, np.int64)
                if block < 0:
                    names, counts = words, b.column(3)[k].values.to_numpy()
                    continue
                found = pc.index_in(words, names)
                have = found.is_valid().to_numpy(zero_copy_only=False)
                c = np.zeros(len(words), "<u8")
                c[have] = counts[found.drop_null().to_numpy()]
                yield record_batch([(block >> 32, block, bucket, packed(c))], ["part", "block", "bucket", "payload"], payload=pa.binary())

    return both.repartition(tasks, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, ANSWER)


# ---- the operator

_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, learns, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, train, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    ``learns`` is a boolean column: rows to learn from.  Both models are counted over all of
    them.  Null and empty texts are an end token alone.  Repeated rows stay repeated; rows
    with a null id are scored.  Without rows to learn from, every byte costs 8 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(learns, F.lit(False)).alias("train")
    )
    blocks = stage(pack_blocks(rows), "ctw-blocks")
    size = blocks.select(F.octet_length("data").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size.n // (256 << 20))

    keys = stage(context_rows(blocks).repartition(tasks, "bucket").sortWithinPartitions("bucket", "block"), "ctw-contexts")
    model, costs, counts = (fresh_path(spark, f"ctw-{x}") for x in ("model", "costs", "counts"))
    root = fit(keys, model, tasks)
    answers_by_part(context_answers(keys, model, root), costs, tasks)
    drop_stage(keys)
    drop_folder(spark, model)

    words = stage(word_rows(blocks), "ctw-words")
    vocab = stage(vocabulary(words), "ctw-vocabulary")
    whole = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = blocks.select(F.size(F.filter("train", lambda x: x)).cast("long").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    answers_by_part(word_answers(words, vocab, tasks), counts, tasks)
    drop_stage(words)
    drop_stage(vocab)
    # the end of a text is one more token, and a word of the vocabulary where there is one
    n_all, distinct = int(whole.n) + ends, whole.v + (ends > 0)
    floor = np.log10(n_all + 0.5 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost_of, count_of = Answers(costs), Answers(counts)
        for b in _blocks(batches):
            _, rank, sizes = b.keys()
            each = np.concatenate([np.zeros(0, "<u2"), *(unpacked(a, "<u2") for a in cost_of.of(b.number))])
            bits = np.add.reduceat(each[rank], np.cumsum(sizes) - sizes, dtype=np.int64) / STEP if len(sizes) else np.zeros(0)
            words, codes, n_words = b.words()
            order, _, _ = _by_word_bucket(words)
            c = np.zeros(len(words))
            if len(order):
                c[order] = np.concatenate([unpacked(a, "<u8") for a in count_of.of(b.number)])
            cost = np.log10(c + 0.5) - floor
            upto = np.append(0, np.cumsum(n_words))
            sums, hits = np.append(0, np.cumsum(cost[codes])), np.append(0, np.cumsum(c[codes] > 0))
            base = sums[upto[1:]] - sums[upto[:-1]] + np.log10(ends + 0.5) - floor
            n_known = hits[upto[1:]] - hits[upto[:-1]] + (ends > 0)
            yield pa.RecordBatch.from_arrays(
                [b.doc_ids, pa.array(b.train), pa.array(n_words + 1), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(n_words), n_all)), pa.array(base), pa.array(-np.log10(2) * bits)],
                [x.split()[0] for x in _SCORED.split(", ")],
            )

    return blocks.mapInArrow(run, _SCORED)


def op9_ctw(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every document.

    Fold 1 of 5 by the id's crc32 is held out; the models learn from all other rows (one with
    a null id is never held out but not learnt from).  Null, empty, long and repeated texts
    as in ``score_documents``; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, F.col("doc_id").isNotNull() & ~held_out(fold=HELD_FOLD))
    return out.select("doc_id", held_out(fold=HELD_FOLD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
