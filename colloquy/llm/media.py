"""Media columns: images in archives, behind a Spark data source.

``media_archive`` writes payloads as 8-bit grey PNG members of archive files and reads them
back.  An archive is its members one after the other, then a directory of them, so any byte
range can be read alone: a partition is a byte range of one archive and owns the members that
begin in it.  A partition is fetched in one ranged read, streamed out in Arrow batches, and a
member that does not have its checksum is fetched again alone, by its offset.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from colloquy.llm.common import fresh_path, table
from colloquy.llm.shared_files import RangeReader, make_folder

WIDTH = 64
#: Bytes of an archive and of a reader's partition, about; bytes of a streamed batch.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20
ATTEMPTS = 4
_MAGIC = b"MEDARCH1"
_NO_ID = -(1 << 63)
_ENTRY = np.dtype([("id", "<i8"), ("n_bytes", "<i8"), ("offset", "<i8"), ("length", "<i8"), ("crc", "<i8")])
_PNG = b"\x89PNG\r\n\x1a\n"
MEMBER = "doc_id long, n_bytes long, uri string, offset long, attempts int, media binary"


def to_png(payload: bytes) -> bytes:
    """Samples, ``WIDTH`` a row, as a lossless 8-bit grey PNG; the same bytes for equal samples."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples of a PNG that ``to_png`` made, as rows."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, shape, data = 8, (0, 0), []
    while at < len(media):
        length, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", media, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Mean and variance (hundredths), mean step along rows, and an 8 x 8 average hash."""
    x = samples.astype(np.int64)
    n, total = x.size, int(x.sum())
    mean = total * 100 // n
    var = (int((x * x).sum()) * n - total * total) * 100 // (n * n)
    step = int(np.abs(np.diff(x, axis=1)).sum()) * 100 // n
    cuts = np.arange(8) * len(x) // 8
    col = x.reshape(len(x), 8, WIDTH // 8).sum(axis=2)
    # each of eight bands of rows begins at its cut; short images repeat rows
    sums = np.array([col[a : max(a + 1, b)].mean(axis=0) for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True)])
    bits = np.packbits(sums > sums.mean()).tobytes().hex()
    return f"mean={mean};var={var};step={step};hash={bits}"


@dataclass
class Archives(WriterCommitMessage):
    found: list


@dataclass
class ByteRange(InputPartition):
    uri: str
    size: int
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        where, path = fs.FileSystem.from_uri(self.folder)
        done, out, entries, at, name = [], None, [], 0, ""

        def close():
            foot = np.array(entries, _ENTRY).tobytes()
            out.write(foot + struct.pack("<qqq", len(entries), at, zlib.crc32(foot)) + _MAGIC)
            out.close()
            done.append((f"{self.folder}/{name}", at, len(entries)))

        for b in iterator:
            ids, sizes = b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist()
            for i, n, payload in zip(ids, sizes, b.column("payload"), strict=True):
                if out is None:
                    name = f"media-{uuid.uuid4().hex}"
                    out, entries, at = where.open_output_stream(f"{path}/{name}"), [], 0
                media = to_png(payload.as_py())
                out.write(media)
                entries.append((_NO_ID if i is None else i, n, at, len(media), zlib.crc32(media)))
                at += len(media)
                if at >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        return Archives(done)

    def commit(self, messages) -> None:
        """Only archives of tasks that ended well are listed; readers see the list."""
        where, path = fs.FileSystem.from_uri(self.folder)
        with where.open_output_stream(f"{path}/list-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([a for m in messages if m for a in m.found]).encode())

    def abort(self, messages) -> None:
        """Nothing was listed, so nothing is read."""


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the list of archives; the directories stay with the tasks."""
        where, path = fs.FileSystem.from_uri(self.folder)
        out = []
        for info in where.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith("list-"):
                with where.open_input_stream(info.path) as f:
                    for uri, size, _ in json.loads(f.read()):
                        out += [ByteRange(uri, size, a, min(size, a + self.range_bytes)) for a in range(0, size, self.range_bytes)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        with RangeReader(partition.uri) as reader:
            own = members(reader, partition.start, partition.end)
            for batch in in_batches(own):
                yield fetch(reader, partition.uri, batch)


def members(reader: RangeReader, start: int, end: int) -> np.ndarray:
    """Directory entries of the members that begin in the byte range."""
    size = reader.size()
    tail = reader.read(size - 32, 32)
    n, at, crc = struct.unpack("<qqq", tail[:24])
    foot = reader.read(at, n * _ENTRY.itemsize)
    if tail[24:] != _MAGIC or zlib.crc32(foot) != crc:
        raise ValueError("not an archive, or a damaged directory")
    entries = np.frombuffer(foot, _ENTRY)
    lo, hi = np.searchsorted(entries["offset"], [start, end])
    return entries[lo:hi]


def in_batches(entries: np.ndarray) -> Iterator[np.ndarray]:
    if len(entries):
        run = (entries["offset"] - entries["offset"][0]) // BATCH_BYTES
        yield from np.split(entries, np.flatnonzero(np.diff(run)) + 1)


def fetch(reader, uri: str, entries: np.ndarray, attempts: int = ATTEMPTS) -> pa.RecordBatch:
    """One ranged read for neighbouring members; each damaged one again, alone, by its offset."""
    first = int(entries["offset"][0])
    try:
        block = reader.read(first, int(entries["offset"][-1] + entries["length"][-1]) - first)
    except OSError:
        block = b""
    media, tries = [], []
    for _, _, offset, length, crc in entries.tolist():
        got, k = block[offset - first : offset - first + length], 1
        while len(got) != length or zlib.crc32(got) != crc:
            if k == attempts:
                raise OSError(f"{uri}: the member at {offset} stays damaged after {k} reads")
            k += 1
            try:
                got = reader.read(offset, length)
            except OSError:
                got = b""
        media.append(got)
        tries.append(k)
    ids = entries["id"].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, mask=ids == _NO_ID),
            pa.array(entries["n_bytes"].astype(np.int64)),
            pa.array([uri] * len(entries)),
            pa.array(entries["offset"].astype(np.int64)),
            pa.array(tries, pa.int32()),
            pa.array(media, pa.binary()),
        ],
        ["doc_id", "n_bytes", "uri", "offset", "attempts", "media"],
    )


class MediaArchive(DataSource):
    """Options: ``path`` (a folder) and ``rangeBytes`` (of a reader's partition)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text, zero-padded to a positive multiple of ``WIDTH``; null: empty."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)) * WIDTH
    return F.rpad(raw, size.cast("int"), F.lit(b"\x00"))


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Archive every row's text as a member; null ids are kept as such."""
    docs.sparkSession.dataSource.register(MediaArchive)
    make_folder(folder)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        payload_of(F.col(text_col)).alias("payload"),
    ).write.format("media_archive").mode("append").save(folder)


def read_media(spark, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a member: doc_id, n_bytes, uri, offset, attempts, media."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("rangeBytes", range_bytes).load(folder)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the samples that each member holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2):
                raw = m.as_py()
                samples = from_png(raw)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(samples)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def op4_media(spark, sf_dir: str) -> DataFrame:
    """Digests and features of every document's padded text as read back from the archives.

    Null texts are empty, and an empty text is one block of zeros; repeated rows are members of
    their own, and equal texts have equal values.  No documents: no members and no rows.
    """
    folder = fresh_path(spark, "media")
    write_media(table(spark, sf_dir, "documents"), folder)
    return media_features(read_media(spark, folder))
