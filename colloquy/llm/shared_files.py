"""Whole files and byte ranges in the shared folder, from inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    where, path = _at(uri)
    where.create_dir(path, recursive=True)


def write_new(folder: str, stem: str, chunks) -> tuple[str, int]:
    """Write chunks to a new file; a task's other attempts get other names.  (uri, bytes)."""
    where, path = _at(folder)
    name = f"{stem}-{uuid.uuid4().hex}"
    size = 0
    with where.open_output_stream(f"{path}/{name}") as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    return f"{folder}/{name}", size


class RangeReader:
    def __init__(self, uri: str):
        where, path = _at(uri)
        self.file = where.open_input_file(path)

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        got = self.file.read(length)
        if len(got) != length:
            raise OSError(f"read {len(got)} of {length} bytes at {start}")
        return got

    def size(self) -> int:
        return self.file.size()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()
