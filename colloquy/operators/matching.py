"""One-to-one matching: optimal assignment."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row and column pairs of least total cost, every row or every column once.

    Shortest augmenting paths with potentials; among equal costs the lower column is tried
    first, so the result is a function of the matrix.
    """
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        reach, via = cost[row] - u[row] - v, np.full(m, -1)
        done, at, level = np.zeros(m, bool), -1, 0.0
        while True:
            at = int(np.argmin(np.where(done, np.inf, reach)))
            level = reach[at]
            done[at] = True
            if owner[at] < 0:
                break
            i = owner[at]
            more = level + cost[i] - u[i] - v
            better = ~done & (more < reach - 1e-15)
            reach[better], via[better] = more[better], at
        held = np.flatnonzero(done)
        for c in held:
            if owner[c] >= 0:
                u[owner[c]] += level - reach[c]
            v[c] -= level - reach[c]
        u[row] += level
        while at >= 0:
            before = via[at]
            owner[at] = owner[before] if before >= 0 else row
            at = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)
