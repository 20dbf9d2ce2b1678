"""Exact substring deduplication by merged Burrows-Wheeler transforms.

A byte is removed if a ``WINDOW``-byte string that covers it also starts in a document with a
smaller id.  Equal windows must meet in one task, without one order over all suffixes:

1. Documents are packed into blocks, a file in the shared folder for each part of the input.
   Tasks read them a block at a time, and none passes through the JVM.
2. Each window's minimizer (the least-hashed K-gram in it) is a function of its content.
   Blocks send their distinct minimizer hashes to buckets by hash range, which send back a
   bit each: seen in two documents or more.  Windows of other minimizers are not repeated.
3. Runs of windows with one repeated minimizer go, as short strings, to buckets by that
   minimizer, each distinct string of a block once, with the least document id that has it.
   A bucket builds the transforms of its shards, merges them and reads off, for each window
   of each string, the least id in its repeated interval.  A minimizer with many different
   strings (a common line, whose surroundings differ) would fill one bucket: its windows go
   one by one, by the hash of the whole window, which is a function of their content as well.
4. Blocks apply the answers to their documents.

Blocks are never shuffled; a very common passage sends one copy a block.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.bwt import least_by_window
from colloquy.llm.common import fresh_path, stage, table
from colloquy.llm.shared_files import make_folder
from colloquy.llm.tokens import slices

WINDOW = 50
K = 20
BLOCK_BYTES = 8 << 20
STRETCH_BYTES = 256 << 10
SHARD_BYTES = 512 << 10
#: Bytes of text for which there is a bucket of hashes, or of strings.
HASH_BUCKET_TEXT, STRING_BUCKET_TEXT = 8 << 20, 4 << 20
#: Further hash bits that part a bucket's strings inside its task: windows never cross them.
#: A block sends a row to each bucket, so buckets are few and parted in their task.
SUB_BITS = 5
#: Strings of one minimizer, over all blocks, beyond which its windows go by their own hashes.
HOT_STRINGS = 4096
#: Different strings of a minimizer in a block that are reported; fewer count as one.
LEAST_COUNTED = 8
#: Windows or bytes that one array step handles.
STEP_ITEMS = 256 << 10
_NONE = np.iinfo(np.int64).max
#: Bits of a packed minimizer for its place; the same in every block, however long.
_POS_BITS = np.uint64(34)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes from each place on."""
    n = len(data) - K + 1
    word = np.empty(len(data) - 7, np.uint64)  # the 8 bytes from each place on
    for k in range(min(8, len(word))):
        own = word[k::8]
        own[:] = data[k : k + 8 * len(own)].view("<u8")
    return _mix(_mix(_mix(word[:n]) + word[8 : n + 8] * np.uint64(0x9E3779B97F4A7C15)) + (word[12 : n + 12] >> np.uint64(32)))


def runs(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: (first window, windows, document, minimizer hash)."""
    empty = np.zeros(0, np.int64)
    if len(data) < WINDOW or not (sizes >= WINDOW).any():
        return empty, empty, empty, empty.astype(np.uint64)
    h = gram_hashes(data)
    at = np.arange(len(h), dtype=np.uint64)
    low = (np.uint64(1) << _POS_BITS) - np.uint64(1)
    m = (h & ~low) | at
    width, have = WINDOW - K + 1, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(m)]
    start = np.flatnonzero(np.arange(len(m)) + WINDOW <= ends[doc])
    best, doc = (m[start] & low).astype(np.int64), doc[start]
    new = np.append(True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    # mixed once more: least hashes crowd at the low end, and hash ranges are the buckets
    return start[first], np.diff(np.append(first, len(start))), doc[first], _mix(h[best[first]])


def window_hashes(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the whole window from each of these places on."""
    out = np.empty(len(first), np.uint64)
    every = np.lib.stride_tricks.sliding_window_view(data, WINDOW) if len(first) else None
    for k in range(0, len(first), STEP_ITEMS // 8):
        own = every[first[k : k + STEP_ITEMS // 8]]
        h = np.zeros(len(own), np.uint64)
        for at in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + own[:, at : at + 8].copy().view("<u8").ravel())
        out[k : k + len(own)] = h
    return out


def ranks(hashes: np.ndarray) -> np.ndarray:
    """Place of each hash among the sorted distinct ones."""
    order = np.argsort(hashes)
    h = hashes[order]
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(np.append(False, h[1:] != h[:-1])[: len(h)])
    return out


def strings_by_hash(data: np.ndarray, first: np.ndarray, n: np.ndarray, h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted distinct hashes have ``LEAST_COUNTED`` different strings or more, and how many."""
    key = ranks(h)
    own = np.flatnonzero((np.bincount(key, minlength=len(keys)) >= LEAST_COUNTED)[key])
    key = key[own]
    # a run has at most WINDOW - K + 1 windows, so its first and last cover it
    said = window_hashes(data, first[own]) * np.uint64(0x9E3779B97F4A7C15) + window_hashes(data, first[own] + n[own] - 1) + n[own].astype(np.uint64)
    order = np.lexsort((said, key))
    key, said = key[order], said[order]
    new = np.append(True, (key[1:] != key[:-1]) | (said[1:] != said[:-1]))[: len(key)]
    counts = np.bincount(key[new], minlength=len(keys))
    many = np.flatnonzero(counts >= LEAST_COUNTED)
    return many, counts[many]


def distinct_hashes(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them two documents or more of the block have."""
    order = np.argsort(hashes)
    h, d = hashes[order], ids[order]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    if not len(h):
        return h, np.zeros(0, bool)
    return h[at], np.minimum.reduceat(d, at) < np.maximum.reduceat(d, at)


class Block:
    """One block of a part's file: documents with ids, their bytes end to end."""

    def __init__(self, b: pa.RecordBatch, k: int):
        self.block = b.column("block")[k].as_py()
        ids = b.column("doc_ids")[k].values
        self.ids = pc.fill_null(ids, 0).to_numpy()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.all_ids = ids
        self.sizes = b.column("sizes")[k].values.to_numpy()
        self.data = np.frombuffer(b.column("data")[k].as_buffer(), np.uint8)
        self.rest = b.column("rest")[k].values if "rest" in b.schema.names else None

    def runs(self):
        # a stretch of documents at a time: hashing needs some fifty bytes of memory a byte
        ends = np.cumsum(self.sizes)
        cuts = np.append(0, np.flatnonzero(np.diff((ends - 1) // STRETCH_BYTES)) + 1) if len(ends) else np.zeros(0, np.int64)
        found = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ends)], strict=True):
            lo = int(ends[a] - self.sizes[a])
            first, n, doc, h = runs(self.data[lo : int(ends[b - 1])], self.sizes[a:b])
            found.append((first + lo, n, doc + a, h))
        first, n, doc, h = (np.concatenate(x) for x in zip(*found, strict=True)) if found else runs(self.data, self.sizes)
        if self.no_id.any():
            ok = ~self.no_id[doc]
            first, n, doc, h = first[ok], n[ok], doc[ok], h[ok]
        return first, n, doc, h


def _blocks(batches: Iterator[pa.RecordBatch], rest: bool = False) -> Iterator[Block]:
    """The blocks of the parts in these rows, one read after the other; with the carried columns
    only where they are asked for."""
    fields = ["block", "doc_ids", "sizes", "data", *(["rest"] if rest else [])]
    for b in batches:
        for uri in b.column("path").to_pylist():
            where, path = fs.FileSystem.from_uri(uri)
            if where.get_file_info(path).type != fs.FileType.File:
                continue  # a part without documents
            with where.open_input_file(path) as f:
                names = pa.ipc.open_file(f).schema.names
                own = pa.ipc.open_file(f, options=pa.ipc.IpcReadOptions(included_fields=[names.index(n) for n in fields], use_threads=False))
                for k in range(own.num_record_batches):
                    yield Block(own.get_batch(k), 0)
            pa.default_memory_pool().release_unused()  # what a worker keeps is kept beside the other's and the JVM's


def pack_blocks(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """A row for each part, ``(part, path, bytes)``, whose file of blocks it writes; ``rest`` there has
    the carried columns of each document."""
    folder = fresh_path(docs.sparkSession, "dedup-blocks")
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        where, path = fs.FileSystem.from_uri(folder)
        mine, writer, block, size = f"{path}/.{part}-{uuid.uuid4().hex}", None, part << 32, 0
        for b in batches:
            for lo, hi in slices(b.column(1), BLOCK_BYTES):
                raw = pc.fill_null(b.column(1).slice(lo, hi - lo), b"")
                sizes = pc.binary_length(raw).cast(pa.int64())
                own = pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]),
                        pa.ListArray.from_arrays([0, hi - lo], b.column(0).slice(lo, hi - lo)),
                        pa.ListArray.from_arrays([0, hi - lo], sizes),
                        pa.array([b"".join(raw.to_pylist())], pa.binary()),
                        pa.ListArray.from_arrays([0, hi - lo], b.column(2).slice(lo, hi - lo)),
                    ],
                    ["block", "doc_ids", "sizes", "data", "rest"],
                )
                if writer is None:
                    sink = where.open_output_stream(mine)
                    writer = pa.ipc.new_file(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False))
                writer.write_batch(own)
                block, size = block + 1, size + len(own["data"][0].as_buffer())
        if writer is not None:
            # every attempt writes the same documents; the rename leaves one whole file
            writer.close()
            sink.close()
            where.move(mine, f"{path}/{part}.arrow")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{folder}/{part}.arrow"]), pa.array([size], pa.int64())], ["part", "path", "bytes"])

    rest = F.struct(*(F.col(f"`{c}`") for c in carry)) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"), rest.alias("rest"))
    return rows.mapInArrow(run, "part long, path string, bytes long")


def _by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present among sorted hashes, and where each begins."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at], np.append(at, len(bucket))


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {n: pa.binary() for n in ("payload", "lengths", "least", "subs", "many")}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.int64())) for k, n in enumerate(names)], names)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Consecutive rows with one value in the first column."""
    at, held = None, []
    for b in batches:
        first = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)] if len(first) else [0]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if first[x] != at and held:
                yield at, held
                held = []
            at = int(first[x])
            held += zip(*(c.slice(x, y - x).to_pylist() for c in b.columns), strict=True)
    if held:
        yield at, held


def hash_rows(blocks: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            first, n, doc, h = b.runs()
            keys, several = distinct_hashes(h, b.ids[doc])
            many, counts = strings_by_hash(b.data, first, n, h, keys)
            marked = ((keys & ~np.uint64(1)) | several).astype("<u8")
            found, at = _by_bucket(keys, bits)
            ends = np.searchsorted(many, at)
            crowd = [np.stack([many[x:y] - a, counts[x:y]]).astype("<u4").tobytes() for a, x, y in zip(at, ends, ends[1:], strict=False)]
            yield _rows(
                [(int(k), b.block, marked[x:y].tobytes(), c) for k, x, y, c in zip(found, at, at[1:], crowd, strict=False)],
                ["bucket", "block", "payload", "many"],
            )

    return blocks.select("path").mapInArrow(run, "bucket long, block long, payload binary, many binary")


def repeated_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's hashes in a bucket, in order: a bit where another document has it too, then
    the places of those with more than ``HOT_STRINGS`` strings."""
    for bucket, rows in _grouped(batches):
        parts = [np.frombuffer(r[2], "<u8") for r in rows]
        marked = np.concatenate(parts)
        keys, several = marked >> np.uint64(1), (marked & np.uint64(1)).astype(bool)
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        again = np.append(False, same) | np.append(same, False)
        hit = np.empty(len(k), bool)
        hit[order] = again
        hit |= several
        ends = np.cumsum([len(p) for p in parts])
        strings = np.ones(len(k), np.int64)
        for r, p, e in zip(rows, parts, ends.tolist(), strict=True):
            own, counts = np.frombuffer(r[3], "<u4").reshape(2, -1).astype(np.int64)
            strings[e - len(p) + own] = counts
        at = np.flatnonzero(np.append(True, ~same))
        over = np.add.reduceat(strings[order], at) > HOT_STRINGS
        hot = np.zeros(len(k), bool)
        if over.any():
            hot[order] = np.repeat(over, np.diff(np.append(at, len(k))))
        bits = lambda x, y: np.packbits(hit[x:y]).tobytes() + np.flatnonzero(hot[x:y]).astype("<u4").tobytes()
        yield _rows(
            [(r[1] >> 32, r[1], bucket, bits(e - len(p), e)) for r, p, e in zip(rows, parts, ends.tolist(), strict=True)],
            ["part", "block", "bucket", "payload"],
        )


_ANSWER = "part long, block long, bucket long, payload binary"


def answers_by_part(rows: DataFrame, folder: str, tasks: int) -> None:
    """Write what buckets answer as one file for each part of the block table."""
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        at = mine = writer = None

        def done():
            # every attempt writes the same rows; the rename leaves one whole file
            writer.close()
            where.move(mine, f"{path}/{at}.parquet")
            return _rows([(at,)], ["part"])

        for b in batches:
            part = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(part)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True):
                if y == x:
                    continue
                if part[x] != at:
                    if writer:
                        yield done()
                    at = int(part[x])
                    mine = f"{path}/.{at}-{uuid.uuid4().hex}"
                    writer = pq.ParquetWriter(mine, b.schema, filesystem=where, compression="zstd")
                writer.write_batch(b.slice(x, y - x))
        if writer:
            yield done()

    rows.repartition(tasks, "part").sortWithinPartitions("part", "block", "bucket").mapInArrow(run, "part long").agg(F.count("*")).first()


def answers_of(folder: str, block: int, held: dict) -> list[bytes]:
    """A block's answers in the order of the buckets; ``held`` keeps the last part's open file, and
    only the row groups that have the block are read."""
    part = block >> 32
    if held.get("part") != part:
        where, path = fs.FileSystem.from_uri(folder)
        held.clear()
        held["part"], held["groups"] = part, []
        name = f"{path}/{part}.parquet"
        if where.get_file_info(name).type == fs.FileType.File:
            held["file"] = pq.ParquetFile(name, filesystem=where)
            meta = held["file"].metadata
            at = held["file"].schema_arrow.get_field_index("block")
            held["groups"] = [(s.min, s.max) for s in (meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups))]
    out: list[bytes] = []
    for k, (low, high) in enumerate(held["groups"]):
        if low <= block <= high:
            t = held["file"].read_row_group(k, columns=["block", "payload"])
            a, b = np.searchsorted(t["block"].to_numpy(), [block, block + 1])
            out += t["payload"].slice(a, b - a).to_pylist()
    return out


def _steps(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to about ``STEP_ITEMS``."""
    if len(n):
        cuts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // STEP_ITEMS)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)], strict=True)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``n`` places of each item."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Strings:
    """A block's distinct strings of repeated windows, ordered by minimizer hash; windows of a
    minimizer with very many strings are strings of their own, under their own hashes."""

    def __init__(self, b: Block, flags: list[bytes], hash_bits: int, bits: int):
        first, n, doc, h = b.runs()
        keys, _ = distinct_hashes(h, b.ids[doc])
        _, at = _by_bucket(keys, hash_bits)
        hit = [np.unpackbits(np.frombuffer(f, np.uint8))[: y - x] for f, x, y in zip(flags, at, at[1:], strict=False)]
        hit = np.concatenate(hit).astype(bool) if hit else np.zeros(0, bool)
        hot = np.zeros(len(keys), bool)
        for f, x, y in zip(flags, at, at[1:], strict=False):
            hot[x + np.frombuffer(f[(y - x + 7) // 8 :], "<u4")] = True
        key = ranks(h)
        kept = np.flatnonzero(hit[key])
        first, n, doc, h, hot = first[kept], n[kept], doc[kept], h[kept], hot[key[kept]]
        if hot.any():
            each = _spread(first[hot], n[hot])
            doc = np.concatenate([doc[~hot], np.repeat(doc[hot], n[hot])])
            h = np.concatenate([h[~hot], window_hashes(b.data, each)])
            first, n = np.concatenate([first[~hot], each]), np.concatenate([n[~hot], np.ones(len(each), np.int64)])
        order = np.argsort(h, kind="stable")
        self.first, self.n, self.doc, h = first[order], n[order], doc[order], h[order]
        lengths = self.n + WINDOW - 1
        ends = np.append(0, np.cumsum(lengths))
        flat = b"".join(b.data[_spread(self.first[x:y], lengths[x:y])].tobytes() for x, y in _steps(lengths))
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)])
        coded = texts.dictionary_encode()
        self.code = coded.indices.to_numpy().astype(np.int64)
        self.texts = coded.dictionary
        one = np.full(len(self.texts), len(self.code), np.int64)
        np.minimum.at(one, self.code, np.arange(len(self.code)))
        self.lengths = lengths[one]
        self.least = np.full(len(self.texts), _NONE, np.int64)
        np.minimum.at(self.least, self.code, b.ids[self.doc])
        # equal strings have equal minimizers, so first-seen order is still by hash
        self.buckets, self.at = _by_bucket(h[one], bits)
        self.sub = ((h[one] >> np.uint64(64 - bits - SUB_BITS)) & np.uint64((1 << SUB_BITS) - 1)).astype(np.uint8)

    def rows(self, block: int) -> list[tuple]:
        ends = np.append(0, np.cumsum(self.lengths))
        data = memoryview(b"".join(self.texts.to_pylist()))
        return [
            (
                int(k),
                block,
                self.lengths[x:y].astype("<u2").tobytes(),
                bytes(data[ends[x] : ends[y]]),
                self.least[x:y].astype("<i8").tobytes(),
                self.sub[x:y].tobytes(),
            )
            for k, x, y in zip(self.buckets, self.at, self.at[1:], strict=False)
        ]


def string_rows(blocks: DataFrame, folder: str, hash_bits: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in _blocks(batches):
            rows = Strings(b, answers_of(folder, b.block, held), hash_bits, bits).rows(b.block)
            yield _rows(rows, ["bucket", "block", "lengths", "payload", "least", "subs"])

    return blocks.select("path").mapInArrow(run, "bucket long, block long, lengths binary, payload binary, least binary, subs binary")


def _shorter(values: np.ndarray) -> bytes:
    """Run-length form of the answers: count, run starts, values."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return np.array([len(values), len(at)], "<i8").tobytes() + at.astype("<i8").tobytes() + values[at].astype("<i8").tobytes()


def _longer(raw: bytes) -> np.ndarray:
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    at, values = np.frombuffer(raw, "<i8", m, 16), np.frombuffer(raw, "<i8", m, 16 + 8 * m)
    return np.repeat(values, np.diff(np.append(at, n)))


def _window_answers(lengths: np.ndarray, text: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Merge the transforms of these strings; the least id by window, string by string."""
    ends = np.append(0, np.cumsum(lengths))
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(text)])
    coded = whole.dictionary_encode()
    code, least = coded.indices.to_numpy().astype(np.int64), np.full(len(coded.dictionary), _NONE, np.int64)
    np.minimum.at(least, code, ids)
    sizes = pc.binary_length(coded.dictionary).to_numpy().astype(np.int64)
    data = np.frombuffer(b"".join(coded.dictionary.to_pylist()), np.uint8)
    answer, n = least_by_window(data, sizes, least, WINDOW, SHARD_BYTES)
    return answer[_spread((np.cumsum(n) - n)[code], n[code])]


def merged_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's answers, one part of its hash range after the other."""
    for bucket, rows in _grouped(batches):
        counts = [len(r[5]) for r in rows]
        lengths = np.frombuffer(b"".join(r[2] for r in rows), "<u2").astype(np.int64)
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        ids = np.frombuffer(b"".join(r[4] for r in rows), "<i8")
        sub = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
        per = lengths - WINDOW + 1
        text_at, ends = np.cumsum(lengths) - lengths, np.append(0, np.cumsum(per))
        values = np.empty(ends[-1], np.int64)
        order = np.argsort(sub, kind="stable")
        cuts = np.append(0, np.cumsum(np.bincount(sub, minlength=1 << SUB_BITS))).tolist()
        for x, y in zip(cuts, cuts[1:], strict=False):
            if y > x:
                own = order[x:y]
                values[_spread(ends[own], per[own])] = _window_answers(lengths[own], data[_spread(text_at[own], lengths[own])], ids[own])
        at = ends[np.append(0, np.cumsum(counts))].tolist()
        out = [(r[1] >> 32, r[1], bucket, _shorter(values[x:y])) for r, x, y in zip(rows, at, at[1:], strict=False)]
        yield _rows(out, ["part", "block", "bucket", "payload"])


def _apply(b: Block, s: Strings, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of the block are removed, and where a removed run begins."""
    values = np.concatenate([_longer(a) for a in answers]) if answers else np.zeros(0, np.int64)
    per = s.lengths - WINDOW + 1
    first = (np.cumsum(per) - per)[s.code]
    edge = np.zeros(len(b.data) + 1, np.int8)  # at most WINDOW windows cover a byte
    for x, y in _steps(s.n):
        n = s.n[x:y]
        least = values[_spread(first[x:y], n)]
        start = _spread(s.first[x:y], n)[least < np.repeat(b.ids[s.doc[x:y]], n)]
        # each window of the block is in one run, so no place comes twice
        edge[start] += 1
        edge[start + WINDOW] -= 1
    gone = np.cumsum(edge[:-1], dtype=np.int8) > 0
    begins = gone & ~np.append(False, gone[:-1])
    heads = (np.cumsum(b.sizes) - b.sizes)[b.sizes > 0]
    begins[heads] = gone[heads]
    return gone, begins


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False, carry: list[str] = ()) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept][, rest])`` for every row.

    ``kept`` is the text left (bytes of characters that a removed run cut are dropped from it,
    not from the checksum); ``rest`` is a struct of the columns named in ``carry``.

    Every byte is removed that lies in a 50-byte string which starts in a document with a
    smaller id as well; rows with the same id do not remove from each other.  Rows with a
    null id neither remove nor lose bytes.  Null and short texts are kept as they are.
    """
    spark = docs.sparkSession
    packed = stage(pack_blocks(docs, id_col, text_col, list(carry)), "dedup-parts")
    total, last, some = packed.agg(F.sum("bytes"), F.max("part"), F.max("path")).first()
    total, parts, folder = total or 0, 0 if last is None else last + 1, (some or "").rpartition("/")[0]
    # a task a part, not what a scan of the small table gives one
    blocks = spark.range(0, parts, 1, max(1, parts)).select(F.concat(F.lit(f"{folder}/"), F.col("id").cast("string"), F.lit(".arrow")).alias("path"))
    hash_bits, bits = (max(least, int(np.ceil(np.log2(max(1, total / x))))) for x, least in ((HASH_BUCKET_TEXT, 6), (STRING_BUCKET_TEXT, 5)))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (256 << 20))

    def by_bucket(rows: DataFrame, bits: int, reduce: Callable) -> DataFrame:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 2)
        return rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(reduce, _ANSWER)

    flags, answers = fresh_path(spark, "dedup-flags"), fresh_path(spark, "dedup-answers")
    answers_by_part(by_bucket(hash_rows(blocks, hash_bits), hash_bits, repeated_bits), flags, files)
    answers_by_part(by_bucket(string_rows(blocks, flags, hash_bits, bits), bits, merged_answers), answers, files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_flags, held_answers = {}, {}
        for b in _blocks(batches, bool(carry)):
            s = Strings(b, answers_of(flags, b.block, held_flags), hash_bits, bits)
            gone, begins = _apply(b, s, answers_of(answers, b.block, held_answers))
            ends = np.cumsum(b.sizes)
            rows = []
            for e, n in zip(ends.tolist(), b.sizes.tolist(), strict=True):
                g = gone[e - n : e]
                removed = int(np.count_nonzero(g))
                kept = b.data[e - n : e][~g].tobytes() if removed else b.data[e - n : e].tobytes()
                rows.append((n, removed, int(np.count_nonzero(begins[e - n : e])), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_kept else ""))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            width = 5 if with_kept else 4
            out = [b.all_ids, *(pa.array(c, t) for c, t in zip(cols[:width], kinds, strict=False))]
            if carry:
                out.append(b.rest)
            yield pa.RecordBatch.from_arrays(out, ["doc_id", *names[:width], *(["rest"] if carry else [])])

    more = ", kept string" if with_kept else ""
    if carry:
        more += f", rest {docs.select(*(f"`{c}`" for c in carry)).schema.simpleString()}"
    return blocks.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every document; nulls, empty, long
    and repeated texts as in ``suffix_dedup``."""
    return suffix_dedup(table(spark, sf_dir, "documents"))
