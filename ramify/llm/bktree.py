"""BK-trees over 64-bit fingerprints under Hamming distance, many trees at once.

Items are rows of arrays; a tree is a root and, for every node, children keyed by
their integer distance to it. Construction goes level by level over all trees
together, and so does the search: it follows only the edges whose key lies within
the radius of the query's distance to the node.
"""

from __future__ import annotations

import numpy as np

KEYS = 65  # distances 0 to 64
PAIRS_AT_ONCE = 1_000_000


class Forest:
    """BK-trees of the items ``members`` (row numbers, ordered by tree)."""

    def __init__(self, prints: np.ndarray, tree: np.ndarray, members: np.ndarray):
        self.prints = prints
        numbers, first, sizes = np.unique(tree[members], return_index=True, return_counts=True)
        self.trees, self.roots, self.sizes = numbers, members[first], sizes
        at = np.repeat(self.roots, sizes)
        rest = np.ones(len(members), bool)
        rest[first] = False
        items, at = members[rest], at[rest]
        keys, children = [], []
        while len(items):
            key = at * KEYS + np.bitwise_count(prints[items] ^ prints[at])
            order = np.argsort(key, kind="stable")
            key, items = key[order], items[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            child = items[new]
            keys.append(key[new])
            children.append(child)
            at = np.repeat(child, np.diff(np.append(np.flatnonzero(new), len(key))))[~new]
            items = items[~new]
        key = np.concatenate([np.empty(0, np.int64), *keys])
        order = np.argsort(key)
        self.key = key[order]
        self.child = np.concatenate([np.empty(0, np.int64), *children])[order]

    def within(self, queries: np.ndarray, tree: np.ndarray, radius: int):
        """Yields (query, member) row numbers at most ``radius`` apart, in blocks."""
        place = np.searchsorted(self.trees, tree[queries])
        place[place == len(self.trees)] = 0
        there = self.trees[place] == tree[queries] if len(self.trees) else np.zeros(len(queries), bool)
        queries, place = queries[there], place[there]
        block = np.cumsum(self.sizes[place]) // PAIRS_AT_ONCE
        for b in np.unique(block):
            query, node = queries[block == b], self.roots[place[block == b]]
            while len(query):
                apart = np.bitwise_count(self.prints[query] ^ self.prints[node]).astype(np.int64)
                near = apart <= radius
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.key, node * KEYS + np.maximum(apart - radius, 0))
                high = np.searchsorted(self.key, node * KEYS + np.minimum(apart + radius, KEYS - 1), "right")
                n = high - low
                start = np.cumsum(n) - n
                node = self.child[np.repeat(low - start, n) + np.arange(n.sum())]
                query = np.repeat(query, n)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row number of its set) after joining a[i] with b[i]."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
