"""Packed R-trees over count vectors, searched with a bound on the overlap of two sets.

An item is a set of tokens, seen as a point: how many of its tokens fall in each of a
few groups. Two sets share at most the sum over the groups of the smaller count. A node
keeps, for all points below it, the largest count of each group and the range of the
set sizes; it is left out of a search when that sum, taken with the largest counts, is
below the overlap that a link needs.
"""

from __future__ import annotations

import numpy as np

LEAF = 8  # points below the lowest nodes
FANOUT = 8
PAIRS_AT_ONCE = 200_000


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """Common tokens that two sets of ``total`` tokens together need for a link."""
    return -(-percent * total // (100 + percent))


def packed_order(points: np.ndarray) -> np.ndarray:
    """Row numbers so that neighbours are close: halved at the median of the widest group."""
    order = np.arange(len(points))
    open_parts = [(0, len(points))]
    while open_parts:
        a, b = open_parts.pop()
        if b - a <= LEAF:
            continue
        part = points[order[a:b]]
        widest = np.argmax(part.max(axis=0) - part.min(axis=0))
        half = (b - a + 1) // 2
        half += -half % LEAF if b - a > 2 * LEAF else 0  # whole leaves
        order[a:b] = order[a:b][np.argpartition(part[:, widest], min(half, b - a - 1), kind="introselect")]
        open_parts += [(a, a + half), (a + half, b)]
    return order


class RTree:
    """R-tree of ``points`` (rows of group counts) with the sizes of their sets."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = packed_order(points)
        self.points, self.sizes = points[self.order], sizes[self.order]
        # Levels from the points up: the largest counts, the least and the largest size.
        self.levels = [(self.points, self.sizes, self.sizes)]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            high, small, large = self.levels[-1]
            at = np.arange(0, len(high), width)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)))
            width = FANOUT

    def candidates(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        """Yields (query, item) row numbers whose bound does not rule out a link, in blocks."""
        depth = len(self.levels) - 1
        block = max(1, PAIRS_AT_ONCE // max(1, len(self.points)))
        for first in range(0, len(points), block):
            query = np.arange(first, min(first + block, len(points)))
            node = np.zeros(len(query), np.int64)
            for level in range(depth, -1, -1):
                high, small, large = self.levels[level]
                size = sizes[query]
                least = np.maximum(small[node], -(-percent * size // 100))  # of the other set
                fits = (least <= large[node]) & (percent * least <= 100 * size)
                query, node, size, least = query[fits], node[fits], size[fits], least[fits]
                bound = np.minimum(points[query], high[node]).sum(axis=1)
                fits = bound >= least_overlap(size + least, percent)
                query, node = query[fits], node[fits]
                if level:
                    width = LEAF if level == 1 else FANOUT
                    below = len(self.levels[level - 1][0])
                    n = np.minimum((node + 1) * width, below) - node * width
                    start = np.cumsum(n) - n
                    node = np.repeat(node * width - start, n) + np.arange(n.sum())
                    query = np.repeat(query, n)
            if len(query):
                yield query, self.order[node]
