"""Tries over letter counts, to find words one edit apart.

A word is the list of how many of its letters fall in each group of letters; the levels
of the trie are the groups, the edges the counts, the leaves the words with the same
counts. One edit adds at most one letter to a group (surplus) and takes at most one from
a group (deficit). A search goes down the edges whose count is the query's, one more while
the surplus is not spent, or one less while the deficit is not spent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUPS = 12
OPEN_AT_ONCE = 100_000  # branches that are followed together
PAIRS_AT_ONCE = 50_000
WIDE = 48  # longer words are compared one by one


# Letters from the most to the least frequent in English.
_FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def letter_groups() -> np.ndarray:
    """The group of each code point up to U+00FF: the frequent letters have the first ones to themselves."""
    groups = np.arange(256) % GROUPS
    for i, letter in enumerate(_FREQUENT):
        groups[ord(letter)] = i if i < GROUPS else GROUPS - 1 - i % GROUPS
    return groups


_GROUP = letter_groups()


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of group counts for every word; letters up to U+00FF."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    group = _GROUP[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    at = np.repeat(np.arange(len(words)), sizes) * GROUPS + group
    return np.bincount(at, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


class FrequencyTrie:
    """Trie over the rows of ``counts``."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1]) if counts.shape[1] else np.arange(len(counts))
        rows = counts[self.order]
        self.base = int(rows.max(initial=0)) + 3
        self.keys = []  # per level: parent node and count of every node, ascending
        node, new = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        new[:1] = True
        for level in range(counts.shape[1]):
            new[1:] |= rows[1:, level] != rows[:-1, level]
            self.keys.append((node * self.base + rows[:, level] + 1)[new])
            node = np.cumsum(new) - 1
        self.first = np.append(np.flatnonzero(new), len(rows))  # of each leaf

    def within(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (query, item) row numbers within what each query may spend."""
        every = np.arange(len(counts))
        todo = [(0, every, np.zeros(len(counts), np.int64), surplus.astype(bool), deficit.astype(bool))]
        while todo:
            level, query, node, more, less = todo.pop()
            if not len(query):
                continue
            if len(query) > OPEN_AT_ONCE:
                half = len(query) // 2
                todo += [(level, query[a:b], node[a:b], more[a:b], less[a:b]) for a, b in ((half, None), (0, half))]
                continue
            if level == len(self.keys):
                n = self.first[node + 1] - self.first[node]
                block = np.cumsum(n) // PAIRS_AT_ONCE
                for b in np.unique(block):
                    q, v, k = query[block == b], node[block == b], n[block == b]
                    yield np.repeat(q, k), self.order[np.repeat(self.first[v] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
                continue
            keys = self.keys[level]
            same = node * self.base + np.minimum(counts[query, level], self.base - 2) + 1
            found = []
            for step, allowed in ((0, None), (1, more), (-1, less)):
                key = (same if allowed is None else same[allowed]) + step
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = keys[at] == key
                pick = hit if allowed is None else np.flatnonzero(allowed)[hit]
                found.append((query[pick], at[hit], more[pick] & (step != 1), less[pick] & (step != -1)))
            todo.append((level + 1, *(np.concatenate(parts) for parts in zip(*found))))


class Words:
    """Words as rows of bytes, for comparing many pairs at once; letters up to U+00FF."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(min(self.sizes.max(initial=0), WIDE)) + 1
        width = max(width, 4)
        self.codes = np.frombuffer(b"".join(w[:width].encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        weight = 1 << np.arange(0, 32, 8)
        self.head = self.codes[:, :4] @ weight
        self.tail = np.array([int.from_bytes(w[-3:].encode("latin-1")) for w in words], np.int64)

    def may_be_near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """An edit leaves the first four letters or, of seven, the last three."""
        return (self.head[a] == self.head[b]) | (self.tail[a] == self.tail[b]) | (np.minimum(self.sizes[a], self.sizes[b]) < 7)

    def one_edit_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        swap = self.sizes[a] < self.sizes[b]
        long, short = np.where(swap, b, a), np.where(swap, a, b)
        n, gap = self.sizes[short], self.sizes[long] - self.sizes[short]
        x, y = self.codes[long], self.codes[short]
        place = np.arange(x.shape[1])
        inside = place < n[:, None]
        differ = (x != y) & inside
        head = np.where(differ.any(axis=1), differ.argmax(axis=1), n)
        moved = (x[:, 1:] != y[:, :-1]) & inside[:, :-1]
        tail = np.where(moved.any(axis=1), n - moved.shape[1] + moved[:, ::-1].argmax(axis=1), n)
        fits = np.where(gap == 0, differ.sum(axis=1) == 1, (gap == 1) & (head + tail >= n))
        for i in np.flatnonzero((self.sizes[long] > WIDE) & (gap <= 1)):
            fits[i] = one_edit_apart(self.words[long[i]], self.words[short[i]])
        return fits


def one_edit_apart(long: str, short: str) -> bool:
    """Whether one inserted, deleted or replaced character makes ``short`` of ``long``, which is not shorter."""
    at = next((i for i, (x, y) in enumerate(zip(long, short)) if x != y), len(short))
    return long != short and long[at + 1 :] == (short[at + 1 :] if len(long) == len(short) else short[at:])
