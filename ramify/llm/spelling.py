"""Spelling variants: words one edit apart, found through frequency-vector tries.

Words and their numbers come from whole texts, summed inside tasks first. Every word is a
list of letter-group counts. The first levels of the trie deal the words to shards: a word
lives in the shard of its own first counts and searches all shards that lie within a surplus
and a deficit of one, each two words in one shard only. A shard's trie has the remaining
levels. The more words, the more levels are dealt, so that shards stay small; a shard above
SHARD_WORDS is cut in parts, and every part is searched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.frequency_trie import GROUPS, FrequencyTrie, Words, letter_counts
from ramify.llm.staging import staged
from ramify.llm.tiles import whole_tiles

LEAST_CHARS = 7
LEAST_COUNT = 2
SPOILED = 31
RATIO = 10  # of a form's number to the word's
USUAL_SHARD = 6000  # words
SHARD_WORDS = 8_000
WORDS_PER_BATCH = 300_000  # counted in a task before they are handed on

_UPPER = {c: c + 32 for c in range(65, 91)}


def spoiled_run(run: str, doc: int, spoiled: int) -> str:
    """``run`` as it stands in a document: in one of ``spoiled`` cases without a letter.

    ``doc`` is the crc32 of the doc_id and a colon.
    """
    h = crc32(run.encode(), doc)
    if h % spoiled:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, spoiled: int = 0) -> DataFrame:
    """(word, n): runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case.

    With ``spoiled`` k, one of k runs loses a letter, as chosen by a hash of doc_id and run.
    Null texts have none; a null doc_id counts as empty.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_chars},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                found = Counter(runs.findall(text.lower() if text.isascii() else text.translate(_UPPER)))
                doc = crc32(f"{doc_id.as_py() or ''}:".encode())
                for run, n in found.items():
                    word = spoiled_run(run, doc, spoiled) if spoiled else run
                    if len(word) >= least_chars:
                        total[word] = total.get(word, 0) + n
                if len(total) > WORDS_PER_BATCH:
                    yield counted()
                    total = {}
        if total:
            yield counted()

    rows = docs.filter("text is not null").select(F.col("doc_id").cast("string"), "text")
    return rows.mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def dealt_levels(words: int) -> int:
    """Levels of the trie that deal words to shards."""
    levels = 1
    while words >> (2 * levels) > USUAL_SHARD and levels < GROUPS:
        levels += 1
    return levels


def _steps(levels: int) -> np.ndarray:
    """What to add to first counts for the shards to search: of a step and its opposite one."""
    unit = np.eye(levels, dtype=np.int64)
    pairs = [unit[a] - unit[b] for a, b in permutations(range(levels), 2)]
    steps = [np.zeros(levels, np.int64), *unit, *-unit, *pairs]
    return np.array([s for s in steps if not s.any() or s[np.flatnonzero(s)[0]] > 0]).reshape(-1, levels)


def _placed(words: DataFrame, levels: int) -> DataFrame:
    """word, n and shards: the hashed first counts of its own shard, then of those it searches."""
    steps, weight = _steps(levels), np.random.default_rng(11).integers(1, 1 << 63, levels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = letter_counts(batch.column(0).to_pylist())[:, None, :levels] + steps
            valid = (first >= 0).all(axis=2)
            keys = (first * weight).sum(axis=2)  # modulo 2^64: a hash of the counts
            ends = np.append(0, np.cumsum(valid.sum(axis=1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(keys[valid], pa.int64()))], names=["word", "n", "shards"]
            )

    return words.select("word", "n").mapInArrow(work, "word string, n bigint, shards array<bigint>")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for words with others one edit apart, how many and the most frequent.

    ``words`` is a written table of distinct (word, n). Of equal n, the smallest word is best.
    """
    levels = dealt_levels(words.count())
    placed = staged(_placed(words, levels), "placed")
    own = F.col("shards")[0]
    large = (
        placed.groupBy(own.alias("shard")).count().filter(F.col("count") > SHARD_WORDS)
        .select("shard", F.ceil(F.col("count") / SHARD_WORDS).cast("int").alias("parts"))
    )
    home = F.when(F.col("pos") == 0, F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    rows = (
        placed.select("word", "n", F.posexplode("shards").alias("pos", "shard"))
        .join(large, "shard", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("home", home)
        # A word searches the parts after its own, where it is at home, and all parts elsewhere.
        .withColumn("part", F.explode(F.sequence(F.coalesce("home", F.lit(0)), F.col("parts") - 1)))
        .select("shard", "part", F.coalesce(F.col("part") == F.col("home"), F.lit(False)).alias("lives"), "word", "n")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_tiles(batches, ["shard", "part"]):
            lives = tile.column("lives").to_numpy()
            if lives.any():
                yield _searched(tile.column("word").to_pylist(), tile.column("n").to_numpy(), lives, levels)

    key = ["shard", "part"]
    found = rows.repartition(*key).sortWithinPartitions(*key, "word").mapInArrow(work, "word string, near bigint, best_n bigint, best string")
    return (
        found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
        .select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")
    )


def _searched(words: list[str], n: np.ndarray, lives: np.ndarray, levels: int) -> pa.RecordBatch:
    """The near words inside one shard: of those that live there and of those that search it.

    ``words`` are in code-point order.
    """
    counts = letter_counts(words)
    members = np.flatnonzero(lives)
    trie = FrequencyTrie(counts[members][:, levels:])
    apart = counts[members[0], :levels] - counts[:, :levels]  # what the first counts have spent
    texts = Words(words)
    near_a, near_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for query, item in trie.within(counts[:, levels:], ~(apart > 0).any(axis=1), ~(apart < 0).any(axis=1)):
        item = members[item]
        once = ~lives[query] | (query < item)
        query, item = query[once], item[once]
        near = texts.may_be_near(query, item)
        query, item = query[near], item[near]
        near = texts.one_edit_apart(query, item)
        near_a.append(query[near])
        near_b.append(item[near])
    a, b = np.concatenate([*near_a, *near_b]), np.concatenate([*near_b, *near_a])
    # Largest n first, then the smallest word: words come in their order.
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    total = np.diff(np.append(first, len(a)))
    found = [[words[i] for i in a[first]], total, n[b[first]], [words[i] for i in b[first]]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word of ``words`` (word, n): word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word, if that is ``ratio`` times as frequent at
    least, else null; root is where the forms lead to, the word itself without a form.
    Letters up to U+00FF; words must be distinct. An empty table gives no rows.
    """
    words = staged(words.select("word", "n"), "words")
    near = staged(near_words(words), "near")
    named = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(to) for c, to in (("best", "form"), ("best_n", "form_n"))],
    )
    named = staged(named, "named")
    # n grows with every step, so that pointers end; each round doubles their length.
    pointer = staged(named.filter("form is not null").select("word", F.col("form").alias("root")), "pointer")
    while True:
        after = pointer.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = staged(pointer.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "pointer")
        pointer = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return named.join(pointer, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
