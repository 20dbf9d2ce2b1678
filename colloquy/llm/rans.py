"""Token-id files coded with a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus, is shared by all files.  A file is a run
of blocks; a block's tokens are dealt to interleaved lanes, each with its own rANS state, so
all lanes step at once as array operations.  Blocks are independent: the footer is a list of
checkpoints (byte offset, first token, tokens, checksum), from which any block is decoded
alone.  Layout of a file, little-endian:

    blocks:   lanes x uint64 final states, then uint32 words in the order the decoder reads
    documents: int64 ids, int64 token counts
    checkpoints: int64 x 5 a block (offset, bytes, first token, tokens, crc32 of the bytes)
    tail:     int64 x 4 (documents, blocks, tokens, crc32 of documents and checkpoints), magic
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import drop_stage, fresh_path, stage, table
from colloquy.llm.shared_files import RangeReader, make_folder, write_new
from colloquy.llm.tokens import part, slices, tokenizer, vocabulary_path

END_ID = 0
LANES = 2048
STEPS = 256
SCALE_BITS = 22
_LOW = np.uint64(1 << 31)
_MAGIC = b"RANSTOK1"
#: Tokens of a file, about.
FILE_TOKENS = 8_000_000


def scaled(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to ``1 << bits``; every counted token has at least 1."""
    counts = counts.astype(np.int64)
    seen = counts > 0
    if not seen.any():
        return counts
    freq = np.where(seen, np.maximum(1, (counts * ((1 << bits) / counts.sum())).astype(np.int64)), 0)
    spare = (1 << bits) - int(freq.sum())
    for k in np.argsort(-freq, kind="stable"):
        step = spare if spare > 0 else max(spare, -(int(freq[k]) // 2))
        freq[k] += step
        spare -= step
        if not spare:
            return freq
    raise ValueError("more distinct tokens than the table has room for")


class Coder:
    """Both directions over one table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self._symbol = None

    def encode(self, tokens: np.ndarray) -> bytes:
        n = len(tokens)
        lanes = min(LANES, n)
        state = np.full(lanes, _LOW, np.uint64)
        words = []
        for at in range((n - 1) // lanes * lanes, -1, -lanes):
            s = tokens[at : at + lanes]
            x, f = state[: len(s)], self.freq[s]
            full = x >= self.limit[s]
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[: len(s)] = (q << self.bits) + (x - q * f) + self.start[s]
        return state.astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))

    def decode(self, data: bytes, n: int) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        lanes = min(LANES, n)
        state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
        words = np.frombuffer(data, "<u4", offset=8 * lanes).astype(np.uint64)
        out = np.empty(n, np.uint32)
        at = 0
        for k in range(0, n, lanes):
            x = state[: min(lanes, n - k)]
            slot = x & self.mask
            s = self._symbol[slot]
            x = self.freq[s] * (x >> self.bits) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
            state[: len(x)] = x
            out[k : k + len(s)] = s
        if at != len(words) or (state != _LOW).any():
            raise ValueError("a block does not end where its encoder began")
        return out


def token_table(docs: DataFrame, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``: ids of each text and the end id, as bytes of the id width.

    Null and empty texts have the end id alone; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(vocabulary)
        for b in batches:
            for lo, hi in slices(b.column(1)):
                ids, counts = tok.encode(part(b.column(1), lo, hi))
                ends = np.cumsum(counts)
                end = np.array([end_id], tok.dtype).tobytes()
                raw = [ids[e - n : e].tobytes() + end for n, e in zip(counts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(counts + 1), pa.array(raw, pa.binary())],
                    ["doc_id", "n_tokens", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids binary"
    )


def frequencies(tokens: DataFrame, width: int, size: int) -> np.ndarray:
    """How often each id occurs in the whole table; one row an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                own = np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def _file_bytes(coder: Coder, doc_ids: np.ndarray, counts: np.ndarray, parts: Iterator[np.ndarray]) -> Iterator[bytes]:
    at = first = 0
    marks, held, kept = [], [], 0
    per_block = LANES * STEPS

    def block(tokens: np.ndarray) -> bytes:
        nonlocal at, first
        data = coder.encode(tokens)
        marks.append((at, len(data), first, len(tokens), zlib.crc32(data)))
        at, first = at + len(data), first + len(tokens)
        return data

    for p in parts:
        held.append(p)
        kept += len(p)
        if kept >= per_block:
            joined = np.concatenate(held)
            whole = len(joined) // per_block * per_block
            for k in range(0, whole, per_block):
                yield block(joined[k : k + per_block])
            held, kept = [joined[whole:]], len(joined) - whole
    if kept:
        yield block(np.concatenate(held))
    foot = doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes() + np.array(marks, "<i8").tobytes()
    yield foot
    yield np.array([len(doc_ids), len(marks), first, zlib.crc32(foot)], "<i8").tobytes() + _MAGIC


def read_footer(reader: RangeReader) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their token counts and the block checkpoints of a file."""
    size = reader.size()
    tail = reader.read(size - 40, 40)
    n_docs, n_blocks, _, crc = np.frombuffer(tail[:32], "<i8").tolist()
    length = 16 * n_docs + 40 * n_blocks
    foot = reader.read(size - 40 - length, length)
    if tail[32:] != _MAGIC or zlib.crc32(foot) != crc:
        raise ValueError("not a token file, or a damaged footer")
    ids = np.frombuffer(foot, "<i8", n_docs)
    counts = np.frombuffer(foot, "<i8", n_docs, 8 * n_docs)
    return ids, counts, np.frombuffer(foot, "<i8", 5 * n_blocks, 16 * n_docs).reshape(-1, 5)


def read_tokens(reader: RangeReader, coder: Coder, marks: np.ndarray, first: int, n: int) -> np.ndarray:
    """Tokens ``first .. first + n`` of a file, from the blocks that hold them only."""
    lo = int(np.searchsorted(marks[:, 2], first, "right")) - 1
    out, at = [], lo
    while at < len(marks) and marks[at, 2] < first + n:
        offset, length, _, tokens, crc = marks[at].tolist()
        data = reader.read(offset, length)
        if zlib.crc32(data) != crc:
            raise ValueError(f"block at {offset} does not have its checksum")
        out.append(coder.decode(data, tokens))
        at += 1
    skip = first - int(marks[lo, 2])
    return np.concatenate(out)[skip : skip + n]


def write_files(tokens: DataFrame, freq: np.ndarray, folder: str, width: int) -> DataFrame:
    """Write the token table in ascending doc_id order; returns one manifest row a file.

    Rows with a null id come first.  Files are named anew by each attempt of a task and only
    those in the returned manifest count.
    """
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = TaskContext.get().partitionId()
        ids, counts = [], []
        kept: list[np.ndarray] = []

        def out(part: int):
            uri, size = write_new(
                folder, f"tokens-{order:06d}-{part:04d}", _file_bytes(coder, np.array(ids, np.int64), np.array(counts, np.int64), iter(kept))
            )
            row = (order, part, uri, len(ids), sum(counts), size)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["task", "part", "uri", "docs", "tokens", "bytes"])

        coder, part, held = Coder(freq), 0, 0
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), f"<u{width}")
                ids.append(-(1 << 63) if i is None else i)
                counts.append(len(own))
                kept.append(own)
                held += len(own)
                if held >= FILE_TOKENS:
                    yield out(part)
                    part, held = part + 1, 0
                    ids.clear(), counts.clear(), kept.clear()
        if ids:
            yield out(part)

    return tokens.orderBy("doc_id").select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        run, "task long, part long, uri string, docs long, tokens long, bytes long"
    )


def read_files(manifest: DataFrame, freq: np.ndarray) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone."""
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("uri", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with RangeReader(uri) as r:
                    ids, counts, marks = read_footer(r)
                    ends = np.cumsum(counts)
                    crcs, lo = [], 0
                    # documents in runs of about a block, so a file is never decoded whole
                    run_of = (ends - counts) // (LANES * STEPS)
                    for hi in [*(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(ids)]:
                        first, n = int(ends[lo] - counts[lo]), int(ends[hi - 1] - ends[lo] + counts[lo])
                        raw = memoryview(read_tokens(r, coder, marks, first, n).astype("<u4")).cast("B")
                        for e, c in zip((ends[lo:hi] - first).tolist(), counts[lo:hi].tolist(), strict=True):
                            crcs.append(zlib.crc32(raw[4 * (e - c) : 4 * e]))
                        lo = hi
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=ids == -(1 << 63)),
                        pa.array(start + ends - counts),
                        pa.array(counts),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    n = max(1, min(manifest.count(), 10_000))
    return placed.repartition(n, "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, np.ndarray]:
    """Tokenize, count, sort and write; (manifest, shared frequency table)."""
    vocabulary = vocabulary or vocabulary_path()
    tok = tokenizer(vocabulary)
    width = np.dtype(tok.dtype).itemsize
    tokens = stage(token_table(docs, vocabulary, end_id), "tokens")
    freq = scaled(frequencies(tokens, width, tok.size))
    manifest = stage(write_files(tokens, freq, folder, width), "token-files")
    drop_stage(tokens)
    return manifest, freq


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the written files.

    Null and empty texts are the end id alone; a repeated row is encoded each time.
    """
    manifest, freq = token_files(table(spark, sf_dir, "documents"), fresh_path(spark, "rans"))
    return read_files(manifest, freq)
