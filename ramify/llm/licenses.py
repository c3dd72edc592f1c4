"""License scans: Dice coefficient of word bigrams against license templates.

Every line, every paragraph and the whole of a text are compared, and so are windows of
words anywhere, for notices inside a longer line or over line ends. A passage has no more
bigrams in common with a template than its text, so most texts are left at once. A template of n
bigrams can only reach Dice d with a passage of n * d / (2 - d) to n * (2 - d) / d
bigrams; most passages fit no template and are left after their words are counted.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm import license_templates

LEAST_DICE = 0.8

# Notices and short licenses as their publishers word them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.",
}

# Letters in lower case; digits and bytes outside ASCII stay; the rest parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_BLANK_LINES = re.compile(r"\n[ \t\r]*\n")


def normalised_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


def passages(text: str) -> Iterator[tuple[str, int, str]]:
    """(unit, number from 0, passage); paragraphs and the whole only where they differ from what came before."""
    lines = text.split("\n")
    for i, line in enumerate(lines):
        yield "line", i, line
    if len(lines) > 1:
        paragraphs = _BLANK_LINES.split(text)
        for i, paragraph in enumerate(paragraphs):
            if "\n" in paragraph:
                yield "paragraph", i, paragraph
        if len(paragraphs) > 1:
            yield "document", 0, text


def word_ranges(text: str) -> dict[tuple[str, int], tuple[int, int]]:
    """(unit, number): the first word and the one after the last."""
    found = {}
    for unit, parts in (("line", text.split("\n")), ("paragraph", _BLANK_LINES.split(text)), ("document", [text])):
        at = 0
        for i, part in enumerate(parts):
            n = len(normalised_words(part))
            found[unit, i] = (at, at + n)
            at += n
    return found


def _meeting(ranges: list[tuple], first: int, end: int) -> list[tuple]:
    """Of sorted ranges that do not overlap, those that share words with the one from first to end."""
    at = max(0, bisect_left(ranges, (first,)) - 1)
    return ranges[at : bisect_left(ranges, (end,))]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.names = list(templates)
        grams = [bigrams(normalised_words(templates[n])) for n in self.names]
        self.sizes = [len(g) for g in grams]
        self.least = least
        self.low = min((n * least / (2 - least) for n in self.sizes), default=0)
        self.high = max((n * (2 - least) / least for n in self.sizes), default=0)
        # A passage that reaches the coefficient shares so many bigrams with the template.
        self.needed = [max(1, n * least / (2 - least) - 1e-9) for n in self.sizes]
        self.order = sorted(range(len(grams)), key=lambda i: self.sizes[i])
        self.sorted_sizes = [self.sizes[i] for i in self.order]
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for i, gram in enumerate(grams):
            for g in gram:
                self.holders.setdefault(g, []).append(i)

    def possible(self, words: list[bytes]) -> list[int]:
        """Templates that some passage of these words may match."""
        shared = Counter(i for g in bigrams(words) & self.holders.keys() for i in self.holders[g])
        return [i for i in sorted(shared) if shared[i] >= self.needed[i]]

    def windows(self, words: list[bytes], possible: list[int]) -> list[tuple[float, str, int, int]]:
        """(dice, template, first word, one after the last): the best windows, none overlapping a better one.

        The best window starts and ends with a bigram of the template: without other ones
        at its ends it is smaller and shares as much.
        """
        pairs = list(zip(words, words[1:]))
        last, before = {}, np.empty(len(pairs), np.int64)  # where each bigram stood before
        for at, pair in enumerate(pairs):
            before[at] = last.get(pair, -1)
            last[pair] = at
        held: dict[int, list[int]] = {i: [] for i in possible}
        for at, pair in enumerate(pairs):
            for i in self.holders.get(pair, ()):
                if i in held:
                    held[i].append(at)
        found = []
        for i in possible:
            hits, size = np.array(held[i]), self.sizes[i]
            hit = np.zeros(len(pairs), bool)
            hit[hits] = True
            most = size * (2 - self.least) / self.least + 1e-9
            reach, enough, late = 3 * int(most) + 2, int(most), []

            def best_from(start: int, new: np.ndarray) -> None:
                """``new``: where the distinct bigrams from ``start`` on stand first, of no more than fit."""
                shared = np.cumsum(hit[new])
                if not len(new) or shared[-1] < self.needed[i]:
                    return
                dice = 2 * shared / (np.arange(1, len(new) + 1) + size)
                top = int(dice.argmax())
                if dice[top] >= self.least:
                    found.append((float(dice[top]), self.names[i], start, int(new[top]) + 2))

            for start in hits.tolist():
                new = start + np.flatnonzero(before[start : start + reach] < start)
                if len(new) <= enough and start + reach < len(pairs):
                    late.append(start)
                else:
                    best_from(start, new[:enough])
            if late:
                # Words that repeat: from right to left, the bigrams by where they stand next.
                wanted, following = set(late), {}
                for at in range(len(pairs) - 1, late[0] - 1, -1):
                    following.pop(pairs[at], None)
                    following[pairs[at]] = at
                    if at in wanted:
                        best_from(at, np.fromiter(islice(reversed(following.values()), enough), np.int64))
        found.sort(key=lambda w: (-w[0], w[2] - w[3], w[2]))
        kept: list[tuple[float, str, int, int]] = []
        firsts: list[int] = []  # of the kept windows, sorted, and the end of each: they do not overlap
        ends: list[int] = []
        for w in found:
            at = bisect_left(firsts, w[2])
            if (at == 0 or ends[at - 1] <= w[2]) and (at == len(firsts) or w[3] <= firsts[at]):
                firsts.insert(at, w[2])
                ends.insert(at, w[3])
                kept.append(w)
        return kept

    def scan(self, text: str) -> list[tuple[str, int, str, float]]:
        """(unit, number, license, dice) of all passages.

        The number of a window is that of its first word. A window stands for a passage of
        its own only if no line, paragraph or text that matches makes it superfluous: one
        that shares half of the words of both, and has the same license or a coefficient as high.
        """
        words = normalised_words(text)
        possible = self.possible(words)
        if not possible:
            return []
        found = [(unit, number, *m) for unit, number, passage in passages(text) for m in self.best(passage)]
        ranges = word_ranges(text)
        # Lines do not overlap each other, nor do paragraphs, so few of a kind meet a window.
        units = {kind: sorted((*ranges[unit, number], name, dice) for unit, number, name, dice in found if unit == kind) for kind in ("line", "paragraph", "document")}
        for dice, name, first, end in self.windows(words, possible):
            if not any(
                2 * (min(end, b) - max(first, a)) >= end - first and 2 * (min(end, b) - max(first, a)) >= b - a and (name == other or dice <= theirs)
                for some in units.values()
                for a, b, other, theirs in _meeting(some, first, end)
            ):
                found.append(("window", first, name, dice))
        return found

    def best(self, passage: str) -> list[tuple[str, float]]:
        """The template with the highest coefficient, the first of equal ones; none below the least."""
        return sorted(self.matches(passage), key=lambda m: -m[1])[:1]

    def matches(self, passage: str) -> list[tuple[str, float]]:
        """Templates at or above the least coefficient."""
        # A passage of n characters has at most n / 2 words, so short ones need no split.
        if len(passage) < 2 * self.low:
            return []
        words = normalised_words(passage)
        if len(words) - 1 < self.low:
            return []
        grams = bigrams(words)
        n = len(grams)
        if not self.low <= n <= self.high:
            return []
        fitting = self.order[
            bisect_left(self.sorted_sizes, n * self.least / (2 - self.least) - 1e-9) : bisect_right(self.sorted_sizes, n * (2 - self.least) / self.least + 1e-9)
        ]
        if not fitting:
            return []
        shared = Counter(i for g in grams if g in self.holders for i in self.holders[g])
        found = [(self.names[i], 2 * shared[i] / (n + self.sizes[i])) for i in sorted(fitting) if shared[i]]
        return [(name, dice) for name, dice in found if dice >= self.least]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, unit, number, license, dice: every passage that matches a template, with the best one.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; the
    coefficient is 2 * |A and B| / (|A| + |B|) of the two sets of word bigrams. Null and
    empty texts, passages and templates of fewer than two words match nothing; repeated
    rows are scanned each; a null doc_id stays null; other columns are ignored; an empty
    table gives no rows. ``templates`` goes to every task; without it they are TEMPLATES and
    the notices and full texts of ``license_templates``.
    """
    if templates is None:
        templates = TEMPLATES | license_templates.NOTICES | license_templates.texts()
    scanner = Scanner(templates, least)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                for match in scanner.scan(text.as_py() or ""):
                    rows.append(row)
                    found.append(match)
            units, numbers, names, dices = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(units, pa.string()), pa.array(numbers, pa.int64()), pa.array(names, pa.string()), pa.array(dices, pa.float64())],
                names=["doc_id", "unit", "number", "license", "dice"],
            )

    return docs.filter(F.length("text") > 0).select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, unit string, number bigint, license string, dice double"
    )
