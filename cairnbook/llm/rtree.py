"""R-trees over count vectors, for joins of sets by a Jaccard threshold.

A set of 64-bit token hashes is indexed as a point: the tokens are hashed into GROUPS groups and the
point holds the number of tokens of each group.  Two sets share at most the sum over groups of the
smaller count; with boxes of points, the sum of the smaller upper bounds.  A pair of boxes whose bound
cannot reach the threshold is skipped with all pairs below it; other pairs are verified on the sets.

Cases: no sets give no pairs; an empty set is a point of zeros and shares nothing; sets are never null, and equal sets meet as any others.
"""

from __future__ import annotations

import numpy as np

GROUPS, LEAF = 64, 16


def points(sets: list[np.ndarray]) -> np.ndarray:
    """Group counts of each set; the group is given by the token's top six bits."""
    if not sets:
        return np.zeros((0, GROUPS), np.int32)
    sizes = np.array([len(s) for s in sets])
    cell = np.repeat(np.arange(len(sets)), sizes) * GROUPS + (np.concatenate(sets) >> np.uint64(58)).astype(np.int64)
    return np.bincount(cell, minlength=len(sets) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


class Node:
    __slots__ = ("high", "kids", "least", "most", "rows")

    def __init__(self, rows, at, sizes, kids=()):
        self.rows, self.kids = rows, kids
        self.high = at[rows].max(0)
        self.least, self.most = sizes[rows].min(), sizes[rows].max()


def build(at: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None = None) -> Node:
    """Bulk load: halve at the median of the coordinate (or the size) that spreads most, down to LEAF points."""
    rows = np.arange(len(sizes)) if rows is None else rows
    if len(rows) <= LEAF:
        return Node(rows, at, sizes)
    spread = at[rows].max(0) - at[rows].min(0)
    widest = int(np.argmax(spread))
    key = sizes[rows] if sizes[rows].max() - sizes[rows].min() >= spread[widest] else at[rows, widest]
    order = rows[np.argsort(key, kind="stable")]
    half = len(order) // 2
    return Node(rows, at, sizes, (build(at, sizes, order[:half]), build(at, sizes, order[half:])))


class Joined:
    """Union-find over the rows of a tree join."""

    def __init__(self, labels: np.ndarray):
        _, first, index = np.unique(labels, return_index=True, return_inverse=True)
        self.up = first[index]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def roots(self, rows: np.ndarray) -> np.ndarray:
        up = self.up[rows]
        while (over := self.up[up] != up).any():
            up[over] = self.up[up[over]]
        self.up[rows] = up
        return up


def link(sets: list[np.ndarray], labels: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (row pairs of Jaccard >= num / den) that join different components, until none is left.

    labels: components known before.  side: with it, only pairs of different sides are looked at.
    Every pair of rows in different components is either bounded away, or verified.
    """
    sizes = np.array([len(s) for s in sets])
    at, joined, out = points(sets), Joined(labels), []
    if len(sets) < 2:
        return out
    root = build(at, sizes)
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if den * min(x.most, y.most) < num * max(x.least, y.least):  # sizes too far apart
            continue
        # shared >= num / (num + den) of the sum of both sizes
        if (num + den) * int(np.minimum(x.high, y.high).sum()) < num * int(x.least + y.least):
            continue
        roots = joined.roots(np.concatenate((x.rows, y.rows)))
        if (roots == roots[0]).all():
            continue
        if side is not None and (both := side[np.concatenate((x.rows, y.rows))]).min() == both.max():
            continue
        if x.kids or y.kids:
            if x is y:
                a, b = x.kids
                stack += [(a, b), (a, a), (b, b)]
            elif x.kids and (not y.kids or len(x.rows) >= len(y.rows)):
                stack += [(k, y) for k in x.kids]
            else:
                stack += [(x, k) for k in y.kids]
            continue
        shared = np.minimum(at[x.rows][:, None, :], at[y.rows][None, :, :]).sum(2)
        close = (num + den) * shared >= num * (sizes[x.rows][:, None] + sizes[y.rows][None, :])
        for i, j in zip(*np.nonzero(close), strict=True):
            a, b = int(x.rows[i]), int(y.rows[j])
            if a >= b and x is y or side is not None and side[a] == side[b]:
                continue
            ra, rb = joined.find(a), joined.find(b)
            if ra == rb:
                continue
            both = np.concatenate((sets[a], sets[b]))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if den * common >= num * (len(both) - common):
                joined.up[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
    return out
