"""Rows that go to buckets and answers that come back to the blocks that asked.

A block table holds runs of documents, one row a block, in parts (the tasks that wrote it).
Tasks send rows ``(bucket, block, ...)``; what the buckets answer is written as one file for
each part, which the tasks of a later pass over the block table read by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared_files import make_folder

ANSWER = "part long, block long, bucket long, payload binary"


def record_batch(rows: list[tuple], names: list[str], **kinds: pa.DataType) -> pa.RecordBatch:
    """Rows as a batch; columns are longs but for those with a kind."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(n, pa.int64())) for k, n in enumerate(names)], names)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Consecutive rows with one value in the first column, read as they come."""

    def rows():
        for b in batches:
            for k in range(b.num_rows):
                yield tuple(c[k].as_py() for c in b.columns)

    every = rows()
    ahead = next(every, None)
    while ahead is not None:
        at = ahead[0]

        def own(at=at):
            nonlocal ahead
            while ahead is not None and ahead[0] == at:
                row = ahead
                ahead = next(every, None)
                yield row

        group = own()
        yield at, group
        for _ in group:
            pass


def answers_by_part(rows: DataFrame, folder: str, tasks: int) -> None:
    """Write ``rows`` (``ANSWER``) as one file for each part of the block table."""
    make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        names = ["part", "block", "bucket", "payload"]
        for part, own in grouped(batches):
            t = pa.Table.from_batches([record_batch(list(own), names, payload=pa.binary())])
            # every attempt writes the same rows; the rename leaves one whole file
            mine = f"{path}/.{part}-{uuid.uuid4().hex}"
            pq.write_table(t, mine, filesystem=where, compression="zstd")
            where.move(mine, f"{path}/{part}.parquet")
            yield record_batch([(part,)], ["part"])

    rows.repartition(tasks, "part").sortWithinPartitions("part", "block", "bucket").mapInArrow(run, "part long").agg(F.count("*")).first()


class Answers:
    """A folder of answers; the last part's file is kept."""

    def __init__(self, folder: str):
        self.folder, self.part = folder, None

    def of(self, block: int) -> list[bytes]:
        """A block's answers in the order of the buckets."""
        part = block >> 32
        if self.part != part:
            where, path = fs.FileSystem.from_uri(self.folder)
            name = f"{path}/{part}.parquet"
            self.blocks, self.rows = np.zeros(0, np.int64), pa.array([], pa.binary())
            if where.get_file_info(name).type == fs.FileType.File:
                t = pq.read_table(name, filesystem=where, columns=["block", "payload"])
                self.blocks, self.rows = t["block"].to_numpy(), pa.concat_arrays(t["payload"].chunks)
            self.part = part
        a, b = np.searchsorted(self.blocks, [block, block + 1])
        return self.rows.slice(a, b - a).to_pylist()
