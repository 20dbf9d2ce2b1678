"""Burrows-Wheeler transforms of short strings, and their merge by interleave refinement.

A shard holds strings, each ended by a terminator below all bytes and read as a cycle.  Its
transform lists, in the order of the rotations, what stands before each rotation; here the
``Q`` symbols before it, as one code.  Transforms are merged without sorting the suffixes of
all shards again: the interleave says which shard each place of the merged order belongs to,
and one stable pass over the codes in the current interleave refines it from the first h
symbols to the first h + Q.  A place where a boundary first shows at a round has that
round's common prefix; places without one after the last round are repeated intervals.
"""

from __future__ import annotations

import numpy as np

#: Symbols a refinement round adds, and those that one number spells out.
Q = 10
_SPELLED = 5
_SYMBOLS = 257


class Cycles:
    """Strings laid out one after the other, each with its terminator."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        size = lengths.astype(np.int64) + 1
        self.n = int(size.sum())
        first = np.cumsum(size) - size
        self.string = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.size = size[self.string].astype(np.int32)
        self.first = first[self.string].astype(np.int64)
        self.offset = (np.arange(self.n) - self.first).astype(np.int32)
        symbols = np.zeros(self.n, np.int64)
        symbols[self.offset < self.size - 1] = data.astype(np.int64) + 1
        self.codes, after = symbols, self.ahead(1)
        for _ in range(1, _SPELLED):
            symbols = symbols[after]
            self.codes = self.codes * _SYMBOLS + symbols

    def ahead(self, k: int) -> np.ndarray:
        """The rotation k symbols further on in the same cycle."""
        at = self.offset + k
        if self.n and abs(k) > self.size.min():
            return self.first + at % self.size
        out = self.first + at
        past = np.flatnonzero(at < 0 if k < 0 else at >= self.size)
        out[past] += self.size[past] if k < 0 else -self.size[past]
        return out


def _stable(symbol: np.ndarray) -> np.ndarray:
    """Stable order of small unsigned numbers, by radix: 16 bits a pass."""
    if symbol.dtype.itemsize <= 2:
        return np.argsort(symbol, kind="stable")
    low = np.argsort((symbol & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((symbol >> 16).astype(np.uint16)[low], kind="stable")]


def _sorted(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 0 to ``most`` in order and their stable order: key and place sort as one number
    where both fit in it, which is several times faster than sorting places."""
    bits = max(len(key) - 1, 1).bit_length()
    if most.bit_length() + bits > 63:
        order = _stable(key.astype(np.uint32)) if most < 1 << 32 else np.argsort(key, kind="stable")
        return key[order], order
    both = (key.astype(np.int64) << bits) | np.arange(len(key))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each key among the distinct keys, and the order of the keys."""
    sorted_key, order = _sorted(key, int(key.max()) if len(key) else 0)
    new = np.empty(len(key), bool)
    new[:1] = False
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, order


def _places(inter: np.ndarray, shards: int) -> np.ndarray:
    """Places of each shard, in its own order."""
    if shards > 8:
        return np.argsort(inter, kind="stable")
    return np.concatenate([np.flatnonzero(inter == s) for s in range(shards)])


def rotation_order(c: Cycles, codes: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of one shard by their first ``depth`` symbols, by doubling."""
    rank, order = _dense(codes)
    ranks, h = {Q: rank}, Q
    while h < depth:
        step = min(h, depth - h)
        step = max(k for k in ranks if k <= step)
        rank, order = _dense(ranks[h] * c.n + ranks[step][c.ahead(h)])
        h += step
        ranks[h] = rank
    return order


def merge(data: np.ndarray, lengths: np.ndarray, shard_bytes: int, depth: int) -> tuple[Cycles, np.ndarray, np.ndarray]:
    """Merge shards of about ``shard_bytes``; (layout, rotations in merged order, common prefix).

    ``prefix[p]`` is how many symbols, in steps of Q, the rotations at p - 1 and p share, or
    ``depth`` where they share that many or more.  ``depth`` is a multiple of Q.
    """
    c = Cycles(data, lengths)
    cut = np.cumsum(lengths.astype(np.int64) + 1)
    shards = min(max(2, -(-c.n // shard_bytes)), 250, len(lengths)) if len(lengths) else 0
    bounds = [0, *(int(np.searchsorted(cut, c.n * k // shards, "left")) + 1 for k in range(1, shards)), len(lengths)] if shards else [0]
    codes, _ = _dense(c.codes)
    codes, _ = _dense(codes * c.n + codes[c.ahead(_SPELLED)])  # of two numbers side by side: Q symbols
    before, most = codes[c.ahead(-Q)], int(codes.max()) if c.n else 0
    tops, transforms, owner = [], [], []
    byte_end = np.append(0, cut)
    for s, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        lo, hi = int(byte_end[a]), int(byte_end[b])
        if hi <= lo:
            continue
        part = Cycles.__new__(Cycles)
        part.n, part.first = hi - lo, c.first[lo:hi] - lo
        part.offset, part.size = c.offset[lo:hi], c.size[lo:hi]
        order = rotation_order(part, codes[lo:hi], depth) + lo
        tops.append(order)
        transforms.append(before[order])
        owner.append(np.full(hi - lo, s, np.uint8))
    if not tops:
        return c, np.zeros(0, np.int64), np.zeros(0, np.int32)
    transform, inter = np.concatenate(transforms), np.concatenate(owner)
    block = np.zeros(c.n, np.int32)
    prefix = np.full(c.n, depth, np.int32)
    prefix[0] = 0
    for h in range(0, depth, Q):
        symbol = np.empty(c.n, np.int64)
        symbol[_places(inter, shards)] = transform
        symbol, step = _sorted(symbol, most)
        inter, block = inter[step], block[step]
        edge = np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
        prefix[edge & (prefix == depth)] = h
        block = np.cumsum(edge, dtype=np.int32)
    merged = np.empty(c.n, np.int64)
    merged[_places(inter, shards)] = np.concatenate(tops)
    return c, merged, prefix


def least_by_window(data: np.ndarray, lengths: np.ndarray, value: np.ndarray, depth: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``depth`` bytes inside a string, the least value of a string with it.

    Returns the answers string by string, window by window, and how many each string has.
    """
    c, merged, prefix = merge(data, lengths, shard_bytes, depth)
    inside = c.offset < c.size - depth
    own = np.where(inside, value[c.string], np.iinfo(np.int64).max)
    starts = np.flatnonzero(prefix < depth)
    out = np.empty(c.n, np.int64)
    if c.n:
        least = np.minimum.reduceat(own[merged], starts)
        out[merged] = np.repeat(least, np.diff(np.append(starts, c.n)))
    return out[inside], np.maximum(lengths.astype(np.int64) - depth + 1, 0)
