import hashlib
import zlib

import numpy as np
import pytest
from colloquy.llm import media
from colloquy.llm.common import fresh_path

from tests.llm.helpers import edge_rows, empty, frame


def payload(t):
    raw = (t or "").encode()
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


@pytest.mark.parametrize("range_bytes", [100, 5000, 1 << 20])
def test_members_come_back_whole_whatever_the_ranges(spark, range_bytes):
    rows = edge_rows()
    folder = fresh_path(spark, "m")
    media.write_media(frame(spark, rows), folder)
    out = media.media_features(media.read_media(spark, folder, range_bytes)).collect()
    want = sorted((str(i), len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r.payload_sha256, set()).add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())


def test_empty_table(spark):
    folder = fresh_path(spark, "m")
    media.write_media(empty(spark), folder)
    assert media.read_media(spark, folder).count() == 0


class Flaky:
    """Spoils the first reads of some offsets."""

    def __init__(self, data, bad):
        self.data, self.bad = data, bad

    def read(self, start, length):
        out = bytearray(self.data[start : start + length])
        for at in list(self.bad):
            if start <= at < start + length and self.bad[at]:
                self.bad[at] -= 1
                out[at - start] ^= 1
        return bytes(out)


def archive(n=5):
    pngs = [media.to_png(bytes([k]) * 64) for k in range(n)]
    at = np.cumsum([0, *map(len, pngs)])
    return b"".join(pngs), np.array([(k, 1, at[k], len(p), zlib.crc32(p)) for k, p in enumerate(pngs)], media._ENTRY)


def test_damaged_members_are_read_again_alone():
    data, entries = archive()
    got = media.fetch(Flaky(data, {int(entries["offset"][2]) + 9: 2}), "u", entries)
    assert got.column("attempts").to_pylist() == [1, 1, 3, 1, 1]
    assert b"".join(got.column("media").to_pylist()) == data


def test_lasting_damage_is_an_error():
    data, entries = archive()
    with pytest.raises(OSError, match="stays damaged"):
        media.fetch(Flaky(data, {9: 99}), "u", entries)


def test_png_round_trip_and_damage():
    raw = np.random.default_rng(2).integers(0, 256, 64 * 7).astype(np.uint8).tobytes()
    png = media.to_png(raw)
    assert media.from_png(png).tobytes() == raw
    with pytest.raises(ValueError):
        media.from_png(png[:50] + b"\x00" + png[51:])
