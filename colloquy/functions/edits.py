"""Edit distances over token arrays, Arrow batch by Arrow batch."""

from __future__ import annotations

from array import array
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Cells of an alignment's table that are kept at once, of two bits each on either side.
HELD_BITS = 1 << 26


def distance(ref, hyp) -> int:
    """Insertions, deletions and substitutions from one token list to the other.

    Bit-parallel: one column of the distance table is two integers whose bits say where the
    column rises or falls from one place of ``ref`` to the next, so a token of ``hyp`` costs a
    few operations on whole machine words.  Equal ends are taken off first.
    """
    lo, a, b = 0, len(ref), len(hyp)
    while lo < min(a, b) and ref[lo] == hyp[lo]:
        lo += 1
    while min(a, b) > lo and ref[a - 1] == hyp[b - 1]:
        a, b = a - 1, b - 1
    n = a - lo
    if not n or b == lo:
        return max(n, b - lo)
    where: dict = {}
    for k in range(n):
        where[ref[lo + k]] = where.get(ref[lo + k], 0) | 1 << k
    every, top = (1 << n) - 1, 1 << (n - 1)
    rises, falls, total = every, 0, n
    for k in range(lo, b):
        same = where.get(hyp[k], 0)
        level = (((same & rises) + rises) ^ rises) | same | falls
        up, down = falls | (every & ~(level | rises)), rises & level
        total += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & every, (down << 1) & every
        crossed = same | falls
        rises, falls = down | (every & ~(crossed | up)), up & crossed
    return total


def edit_distance(ref: Column, hyp: Column) -> Column:
    """Distance of two token arrays; null counts as no tokens."""

    @F.pandas_udf("int")
    def batch(ref, hyp):
        import pandas as pd

        return pd.Series([distance(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)], dtype="int32")

    none = F.array().cast("array<string>")
    return batch(F.coalesce(ref, none), F.coalesce(hyp, none))


def rate(edits: Column, n_ref: Column, n_hyp: Column) -> Column:
    """Edits over reference tokens; an empty reference gives 0 against nothing, else 1."""
    return F.when(n_ref == 0, F.when(n_hyp == 0, 0.0).otherwise(1.0)).otherwise(edits / n_ref)


def alignment(ref, hyp, held: int = HELD_BITS) -> list[tuple[int | None, int | None]]:
    """Places of ``ref`` and ``hyp`` side by side in a least edit; None where one side has nothing.

    Read from the end, a pair goes before a lost token and that before an added one.  Each
    column of the distance table is kept as bits, steps down (from one place of ``ref`` to the
    next) and steps across (from one token of ``hyp`` to the next), and the way back asks them.
    A table of over ``held`` cells is kept as every so many columns, and the columns between two
    of them are made again when the way back gets there.
    """
    n, m = len(ref), len(hyp)
    every, where = (1 << n) - 1, {}
    for k, x in enumerate(ref):
        where[x] = where.get(x, 0) | 1 << k

    def column(x, rises: int, falls: int) -> tuple[int, int, int, int]:
        same = where.get(x, 0)
        level = (((same & rises) + rises) ^ rises) | same | falls
        over, less = falls | (every & ~(level | rises)), rises & level
        up, lower = (over << 1 | 1) & every, (less << 1) & every
        crossed = same | falls
        return lower | (every & ~(crossed | up)), up & crossed, over, less

    block = max(m, 1) if n * m <= held else isqrt(m) + 1
    kept, now = [], (every, 0)
    for k, x in enumerate(hyp if block < m else ()):
        if k % block == 0:
            kept.append(now)
        now = column(x, *now)[:2]
    kept = kept or [(every, 0)]

    def step(bits: tuple[int, int], k: int) -> int:
        return (bits[0] >> k & 1) - (bits[1] >> k & 1)

    i, j, pairs, low = n, m, [], m
    down, across = [(every, 0)], [(0, 0)]
    while i or j:
        if j and j <= low:  # down and across are of the columns from ``low`` on
            low = (j - 1) // block * block
            down, across = [kept[low // block]], [(0, 0)]
            for x in hyp[low : min(low + block, m)]:
                got = column(x, *down[-1])
                down.append(got[:2])
                across.append(got[2:])
        at = j - low if j else 0
        if i and j and step(across[at], i - 1) + step(down[at - 1], i - 1) == (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif i and (not j or step(down[at], i - 1) == 1):
            i -= 1
            pairs.append((i, None))
        else:
            j -= 1
            pairs.append((None, j))
    return pairs[::-1]


def aligned(ref: Column, hyp: Column) -> Column:
    """``array<struct<i, j>>``: places of two token arrays side by side; null counts as no tokens."""

    @F.arrow_udf("array<struct<i: int, j: int>>")
    def batch(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        # places as flat numbers: eight bytes a pair for a whole batch, -1 for none
        ends, sides = [0], (array("i"), array("i"))
        for a, b in zip(ref, hyp, strict=True):
            for pair in alignment(a.as_py(), b.as_py()):
                for side, x in zip(sides, pair, strict=True):
                    side.append(-1 if x is None else x)
            ends.append(len(sides[0]))
        i, j = (pa.array(x, pa.int32(), mask=x < 0) for x in (np.frombuffer(s, np.int32) if len(s) else np.zeros(0, np.int32) for s in sides))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([i, j], ["i", "j"]))

    none = F.array().cast("array<string>")
    return batch(F.coalesce(ref, none), F.coalesce(hyp, none))
