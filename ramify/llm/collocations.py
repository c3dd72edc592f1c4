"""Collocations by SON partitioning: mine shards completely, then count all that was found.

A phrase of support s in a language of N words has, in at least one of the shards of that
language, the share of s that the shard has of N. So every shard is mined completely at its
own lowered support, level by level: a phrase can only be frequent there if the two phrases
one word shorter in it are. What any shard finds is a candidate, unless its numbers there and
the most that the other shards can have without finding it are below s together. A second
scan counts all candidates, exactly.

Texts are tokenised twice: to count words, and to write them as hashes of frequent words, on
which the scans for pairs and for longer phrases work. Frequent pairs, as bits of bounded size,
prune the mining of longer phrases. Bits only prune: with wrong positives more is counted and
the result is the same. Hashes of words are tried until no two words of a language share one.

A language has about SHARDS shards, and more where one would outgrow SHARD_WORDS. Where a
shard has less than 1 / s of its language, its support is 1: all its phrases of frequent words
are candidates then, at most as many rows as the shard has phrases.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import count as numbers_from

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.staging import staged, text_or_empty
from ramify.operators.ranking import top_k

SUPPORT = 100
LONGEST = 5
TOP = 2000
SHARDS = 32
SHARD_WORDS = 2_000_000  # of one language, in a task's memory
WORDS_PER_BATCH = 300_000  # counted in a task before they are handed on
DOCUMENTS_PER_BATCH = 256
FEW_WORDS = 8_000_000  # frequent words whose hashes are sent to every task
FEW_LANGUAGES = 10_000
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
BITS_PER_PHRASE = 32
TESTS = 4  # bits that a phrase sets
MOST_WORDS = 400_000  # whose hashes a worker remembers

# Ends of pieces become a word of its own, a full stop; a tab is a space.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, and a full stop wherever a piece ends."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_ENDS).replace(b".", b" . ").split()


class _WordHashes(dict):
    """Word -> hash, never 0; 0 is what parts pieces."""

    def __init__(self, seed: int):
        super().__init__({b".": 0})
        self._seed = seed

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > MOST_WORDS:
            self.clear()
            self[b"."] = 0
        digest = xxh64_intdigest(word, seed=self._seed) or 1
        if len(word) <= 64:
            self[word] = digest
        return digest


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    return _mixed(left * _A + word)


class Shard:
    """Texts of one language as hashes of words, 0 between pieces and for other words.

    ``frequent`` has the sorted hashes of the words that count, or is None.
    """

    def __init__(self, hashes: np.ndarray, frequent: np.ndarray | None):
        self.hashes = hashes
        words, self.numbers = (frequent, np.searchsorted(frequent, hashes)) if frequent is not None else np.unique(hashes[hashes > 0], return_inverse=True)
        if frequent is None:
            found, self.numbers = self.numbers, np.zeros(len(hashes), np.int64)
            self.numbers[hashes > 0] = found
        self.words = np.append(words, np.uint64(0))
        known = self.words[self.numbers] == hashes
        self.numbers = np.where(known & (hashes > 0), self.numbers + 1, 0)

    def phrase_hashes(self, length: int, at: np.ndarray) -> np.ndarray:
        found = self.hashes[at]
        for i in range(1, length):
            found = _joined(found, self.hashes[at + i])
        return found

    def phrases(self, at: np.ndarray, length: int) -> np.ndarray:
        return np.stack([self.hashes[at + i] for i in range(length)], axis=1)

    def pairs(self, bits: np.ndarray | None) -> np.ndarray:
        """Whether a pair of frequent words stands at each place but the last, one that ``bits`` has."""
        found = (self.numbers[:-1] > 0) & (self.numbers[1:] > 0)
        if bits is not None:
            at = np.flatnonzero(found)
            found[at] = has(bits, self.phrase_hashes(2, at))
        return found

    def mined(self, support: int, lengths: range, pairs: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of each of ``lengths`` that occur ``support`` times, as rows of hashes; numbers of times."""
        seen = np.bincount(self.numbers, minlength=1)
        level = np.where((seen >= support)[self.numbers], self.numbers, 0)  # class of the phrase at each place
        for length in range(2, lengths.stop):
            if len(level) < 2:
                return
            together = (level[:-1] > 0) & (level[1:] > 0)
            at = np.flatnonzero(together & self.pairs(pairs) if length == 2 else together)
            kinds, inverse, counts = np.unique(level[at] << 32 | level[at + 1], return_inverse=True, return_counts=True)
            frequent = counts >= support
            if length in lengths:
                first = np.empty(len(kinds), np.int64)
                first[inverse] = at
                yield self.phrases(first[frequent], length), counts[frequent]
            number = np.where(frequent, np.cumsum(frequent), 0)
            level = np.zeros(len(level) - 1, np.int64)
            level[at] = number[inverse]

    def counted(self, lengths: range, bits: np.ndarray, pairs: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of ``lengths`` that ``bits`` has, exactly counted."""
        fits = self.pairs(pairs)
        whole = np.ones(len(self.numbers), bool)
        for length in range(2, lengths.stop):
            if len(self.numbers) < length:
                return
            whole = whole[:-1] & fits[length - 2 :]
            if length not in lengths:
                continue
            at = np.flatnonzero(whole)
            at = at[has(bits, self.phrase_hashes(length, at))]
            kind = self.numbers[at]
            for i in range(1, length):
                _, kind = np.unique(kind << 32 | self.numbers[at + i], return_inverse=True)
            _, first, counts = np.unique(kind, return_index=True, return_counts=True)
            yield self.phrases(at[first], length), counts


def _places(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The bits of each hash among ``size``, one of them at a time."""
    for _ in range(TESTS):
        hashes = _mixed(hashes * _A)
        yield hashes & np.uint64(size - 1)


def has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.arange(len(hashes))
    for place in _places(hashes, 8 * len(bits)):
        place = place[found]
        found = found[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(hashes), bool)
    out[found] = True
    return out


def phrase_bits(phrases: DataFrame) -> np.ndarray:
    """Bits that mark ``phrases.hashes``: BITS_PER_PHRASE for each at least, up to MOST_BITS."""
    size = LEAST_BITS
    while size < BITS_PER_PHRASE * phrases.count() and size < MOST_BITS:
        size *= 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column(0).values.to_numpy().view(np.uint64), batch.column(0).offsets.to_numpy()
            lengths = np.diff(ends)
            for length in np.unique(lengths):
                first = ends[:-1][lengths == length]
                found = values[first]
                for i in range(1, length):
                    found = _joined(found, values[first + i])
                for place in _places(found, size):
                    yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], names=["place"])

    places = phrases.select("hashes").mapInArrow(work, "place bigint")
    bit = F.expr("shiftleft(1L, cast(place & 31 as int))")
    found = places.groupBy(F.shiftright("place", 5).alias("block")).agg(F.bit_or(bit).alias("bits")).toArrow()  # size / 32 rows at most
    bits = np.zeros(size // 32, "<u4")
    bits[found.column("block").to_numpy()] = found.column("bits").to_numpy()
    return bits.view(np.uint8)


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, word, hash, f) of every word of ``texts`` (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = defaultdict(Counter)
        hashes = _WordHashes(seed)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, counts in total.items():
                counts.pop(b".", None)
                words = [w.decode("utf-8", "surrogatepass") for w in counts]
                each = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(each), pa.array(counts.values(), pa.int64())], names=["lang", "word", "hash", "f"])
            total.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                total[lang.as_py()].update(tokens(text.as_py()))
                if sum(map(len, total.values())) > WORDS_PER_BATCH:
                    yield from handed_on()
        yield from handed_on()

    rows = texts.mapInArrow(work, "lang string, word string, hash bigint, f bigint")
    return rows.groupBy("lang", "word").agg(F.any_value("hash").alias("hash"), F.sum("f").alias("f"))


def _hashed(texts: DataFrame, frequent, seed: int) -> DataFrame:
    """(lang, total, n, hashes): each text of ``texts`` (lang, total, text) as hashes of frequent words.

    0 stands for an end of a piece or for one or more other words, and at the end; n counts all words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = frequent.value if frequent else None, _WordHashes(seed)
        for batch in (b.slice(at, DOCUMENTS_PER_BATCH) for b in batches for at in range(0, b.num_rows, DOCUMENTS_PER_BATCH)):
            words = [tokens(t.as_py()) for t in batch.column(2)]
            sizes = np.array([len(w) + 1 for w in words])
            each = np.fromiter((h for w in words for h in (*map(hashes.__getitem__, w), 0)), np.uint64, int(sizes.sum()))
            row = np.repeat(np.arange(len(words)), sizes)
            ends = np.array([w.count(b".") + 1 for w in words])
            if known is not None:
                at = np.searchsorted(known, each)
                at[at == len(known)] = 0
                each[(known[at] != each) if len(known) else slice(None)] = 0
            kept = (each > 0) | (np.append(1, each[:-1]) > 0) | (np.diff(row, prepend=-1) > 0)
            offsets = np.append(0, np.cumsum(np.bincount(row[kept], minlength=len(words)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(each[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((sizes - ends).astype(np.int64)), lists], names=["lang", "total", "n", "hashes"])

    return texts.select("lang", "total", "text").mapInArrow(work, "lang string, total bigint, n bigint, hashes array<bigint>")


def _by_shard(rows: DataFrame, frequent, job: Callable[[Shard, int, int], Iterator[tuple[np.ndarray, np.ndarray, int]]]) -> DataFrame:
    """(lang, hashes, f, slack): what ``job`` makes of every shard, the number of its words and that of its language."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value if frequent else None
        waiting: dict[str, list] = {}  # texts with their words, words of them all, words of the language

        def done(lang: str, texts: list, total: int) -> Iterator[pa.RecordBatch]:
            shard = Shard(np.concatenate([t for t, _ in texts]), known)
            for phrases, counts, slack in job(shard, sum(n for _, n in texts), total):
                offsets = np.arange(len(phrases) + 1, dtype=np.int32) * phrases.shape[1]
                lists = pa.ListArray.from_arrays(offsets, pa.array(phrases.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(phrases), pa.string()), lists, pa.array(counts.astype(np.int64)), pa.array(np.full(len(phrases), slack, np.int64))],
                    names=["lang", "hashes", "f", "slack"],
                )

        def cut(lang: str, most: int) -> Iterator[pa.RecordBatch]:
            """Shards of half of what waits, so that no small rest is left."""
            texts, n, total = waiting[lang]
            first, size = [], 0
            while texts and size < most:
                first.append(texts.pop(0))
                size += first[-1][1]
            waiting[lang][1] = n - size
            yield from done(lang, first, total)

        for batch in batches:
            values, ends = batch.column(3).values.to_numpy().view(np.uint64), batch.column(3).offsets.to_numpy()
            for lang, total, n, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), ends, ends[1:]):
                mine = waiting.setdefault(lang, [[], 0, total])
                mine[0].append((values[a:b].copy(), n))
                mine[1] += n
                most = min(SHARD_WORDS, -(-total // SHARDS))
                if mine[1] >= 2 * most and len(mine[0]) > 1:
                    yield from cut(lang, most)
            if sum(x[1] for x in waiting.values()) > 4 * SHARD_WORDS:
                largest = max(waiting, key=lambda x: waiting[x][1])
                yield from cut(largest, waiting[largest][1])
        for lang, (texts, _, total) in waiting.items():
            if texts:
                yield from done(lang, texts, total)

    return rows.select("lang", "total", "n", "hashes").mapInArrow(work, "lang string, hashes array<bigint>, f bigint, slack bigint")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of words and phrases that occur ``support`` times; (lang, n) of all words."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty(F.col("text")).alias("text"))
    for seed in numbers_from():
        words = staged(word_counts(texts, seed), "words")
        if words.groupBy("lang", "hash").count().filter("count > 1").isEmpty():
            break
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    single = staged(words.filter(F.col("f") >= support), "single")
    sc = docs.sparkSession.sparkContext
    # One list for all languages: a word that is frequent in another one is mined in vain.
    frequent = None
    if single.count() <= FEW_WORDS:
        frequent = sc.broadcast(np.unique(single.select("hash").toArrow().column(0).to_numpy().view(np.uint64)))
    # Languages without frequent words have no phrases. The total comes along, whatever the number of languages.
    some = staged(totals.join(single.select("lang").distinct(), "lang", "left_semi"), "some")
    some = F.broadcast(some) if some.count() <= FEW_LANGUAGES else some
    hashed = staged(_hashed(texts.join(some, "lang").withColumnRenamed("n", "total"), frequent, seed), "hashed")
    found, bits = [], None
    for lengths in (range(2, 3), range(3, longest + 1)):
        if not len(lengths):
            continue

        def mine(shard: Shard, n: int, total: int, lengths=lengths, pairs=bits) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            local = max(1, -(-support * n // total))
            yield np.zeros((1, 0), np.uint64), np.zeros(1), local - 1  # a shard without findings has its slack too
            for phrases, counts in shard.mined(local, lengths, pairs.value if pairs else None):
                yield phrases, counts, local - 1

        local = staged(_by_shard(hashed, frequent, mine).groupBy("lang", "hashes").agg(F.sum("f").alias("f"), F.sum("slack").alias("slack")), "local")
        slack = staged(local.filter(F.size("hashes") == 0).select("lang", F.col("slack").alias("most")), "slack")
        slack = F.broadcast(slack) if slack.count() <= FEW_LANGUAGES else slack
        possible = local.filter(F.size("hashes") > 0).join(slack, "lang").filter(F.col("f") + F.col("most") - F.col("slack") >= support)
        possible = staged(possible.select("lang", "hashes"), "candidates")
        chosen = sc.broadcast(phrase_bits(possible))

        def counted(shard: Shard, n: int, total: int, lengths=lengths, chosen=chosen, pairs=bits) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
            for phrases, counts in shard.counted(lengths, chosen.value, pairs.value if pairs else None):
                yield phrases, counts, 0

        exact = _by_shard(hashed, frequent, counted).groupBy("lang", "hashes").agg(F.sum("f").alias("f")).filter(F.col("f") >= support)
        exact = staged(exact.join(possible, ["lang", "hashes"], "left_semi"), "frequent")
        found.append(exact)
        bits = sc.broadcast(phrase_bits(exact))
    phrases = single.select("lang", F.array("hash").alias("hashes"), "f")
    for more in found:
        phrases = phrases.unionByName(more)
    named = (
        phrases.select("lang", "hashes", "f", F.posexplode("hashes").alias("pos", "hash"))
        .join(single.select("lang", "hash", "word"), ["lang", "hash"])
        .groupBy("lang", "hashes").agg(F.any_value("f").alias("f"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
        .select("lang", F.array_join("w.word", " ").alias("phrase"), F.size("w").alias("words"), "f")
    )
    return staged(named, "phrases"), totals


def _whole(number: Column) -> Column:
    return number.cast("decimal(19,0)")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` collocations of every language.

    a, l and r are the occurrences of the phrase, of its first part and of the rest, n the
    words of the language; score is floor(1000 a n / (l r)) at the cut where it is lowest, the
    first of equal ones. Phrases of 2 to ``longest`` words within a piece with a >= ``support``;
    left out are those that never occur outside a longer one. Equal scores go by a, then by phrase.

    Null texts are empty, a null lang is ``und``. Repeated rows count each; an empty table
    gives no rows; other columns are ignored.
    """
    phrases, totals = frequent_phrases(docs, support, longest)
    candidates = phrases.filter("words > 1")
    parts = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "k", F.col("f").alias("a"),
        F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice(parts, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    first = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = cuts.join(first, ["lang", "left"]).join(rest, ["lang", "right"]).join(totals, "lang")
    met = met.withColumn("up", _whole(F.col("a") * 1000) * _whole(F.col("n"))).withColumn("down", _whole(F.col("l")) * _whole(F.col("r")))
    scored = (
        met.withColumn("score", F.expr("up div down"))
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
        .select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")
    )
    # A phrase that occurs in a longer one only does so in one that is one word longer.
    longer = candidates.filter("words > 2").select("lang", F.col("f").alias("a"), F.explode(F.array(
        F.array_join(F.slice(parts, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("words") - 1), " "),
    )).alias("phrase")).distinct()
    kept = scored.join(longer, ["lang", "phrase", "a"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = top_k(kept, ["lang"], order, top, "rank", spread="phrase")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
