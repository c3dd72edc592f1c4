"""SimHash near-duplicates, linked through sharded BK-trees.

Fingerprints of whole texts are made inside tasks. Equal fingerprints are one class.
Classes are dealt to shards so that any two within the radius meet in at least one:
the 64 bits are cut into radius + k blocks, of which k must be equal, and a shard is
one choice of k blocks with their bits. Every shard has its BK-tree, searched with
the shard's own fingerprints along the edges within the radius. Trees of all shards
against all fingerprints would give the same links at a cost that grows with the
square of the input; k grows with the number of classes instead, so that shards stay
small. A shard above SHARD_ROWS is cut into chunks, and every pair of chunks is
searched as a task of its own, so that no tree outgrows a task.

A task returns a spanning forest of the links it finds, at most one row per
fingerprint; the components are then joined up across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.bktree import Forest, join_labels
from ramify.llm.components import connected_components
from ramify.llm.staging import carried, staged, unpacked

RADIUS = 4
SHINGLE = 4
SEED = 42
SHARD_ROWS = 2048
BROADCAST_ROWS = 1_000_000  # of ids and hashes; more are joined by shuffle
USUAL_SHARD = 64  # classes per shard on average, at most

_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], np.int64)
_BYTE = np.arange(8) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes.

    A-Z in lower case; words are what ASCII white space leaves; shingles of ``shingle``
    words, repeats included, a shorter text being one; a text without words gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = partial(xxh64_intdigest, seed=seed)
    spans = zip(starts, ends[shingle - 1 :]) if len(words) > shingle else [(0, len(joined) + 1)]
    hashes = np.fromiter((digest(joined[a : b - 1]) for a, b in spans), np.uint64)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
    ones = np.einsum("jv,vb->jb", seen.reshape(8, 256), _BITS)
    packed = np.packbits(2 * ones > len(hashes), axis=1, bitorder="little")
    return int.from_bytes(packed.tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash of the text) and fp, the fingerprint's 64 bits as a bigint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.int64())], names=["doc_id", "_text", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(work, f"doc_id {kind}, _text bigint, fp bigint")


def block_masks(radius: int, equal: int) -> list[int]:
    """Signed 64-bit masks: every choice of ``equal`` out of radius + equal blocks."""
    n = radius + equal
    bounds = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]
    masks = [sum(choice) for choice in combinations(blocks, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def equal_blocks(classes: int, radius: int) -> int:
    """Blocks that must be equal so that an average shard has at most USUAL_SHARD classes."""
    equal = 1
    while classes >> (64 * equal // (radius + equal)) > USUAL_SHARD and equal < 8:
        equal += 1
    return equal


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links within ``radius`` that join up every component of distinct ``fp``."""
    masks = block_masks(radius, equal_blocks(classes.count(), radius))
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    rows = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.*")
    hot = (
        rows.groupBy("choice", "bits").count().filter(F.col("count") > SHARD_ROWS)
        .select("choice", "bits", F.ceil(F.col("count") / SHARD_ROWS).cast("int").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    tiles = (
        rows.join(hot, ["choice", "bits"], "left")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
        .select("choice", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "fp")
    )
    key = ["choice", "bits", "low", "high"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: np.ndarray | None = None

        def whole_tiles():
            """Rows as columns of an array, cut only between tiles."""
            nonlocal kept
            for batch in batches:
                new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
                rows = new if kept is None else np.concatenate([kept, new], axis=1)
                change = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))
                last = change[-1] + 1 if len(change) else 0
                kept = rows[:, last:]
                if last:
                    yield rows[:, :last]
            if kept is not None and kept.shape[1]:
                yield kept

        for rows in whole_tiles():
            tile = np.zeros(rows.shape[1], np.int64)
            tile[1:] = np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))
            prints = rows[5].astype(np.uint64)
            labels = np.arange(len(tile))
            forest = Forest(prints, tile, np.flatnonzero(rows[4] == rows[2]))
            for a, b in forest.within(np.flatnonzero(rows[4] == rows[3]), tile, radius):
                labels = join_labels(labels, a, b)
            moved = np.flatnonzero(labels != np.arange(len(tile)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(rows[5][moved]), pa.array(rows[5][labels[moved]])], names=["a", "b"])

    return tiles.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(work, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id; also _text, fp and root.

    root names the component, _text is a hash of the text.

    component_id is the smallest doc_id that can be reached over fingerprints within
    ``radius`` bits of each other. Null and empty texts have fingerprint 0. A null
    doc_id is no component_id, unless a component has no other. Repeated rows are
    returned each; an empty table gives no rows; other columns are ignored.
    """
    prints = staged(fingerprints(docs), "prints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(links(classes, radius))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(smallest, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id.

    Where rows repeat that doc_id, the one with the smallest text hash stays, once. Nulls
    and empty tables as in ``near_duplicates``.
    """
    found = staged(near_duplicates(docs, radius).select("doc_id", "_text", "root", "component_id"), "found")
    smallest = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = staged(found.filter(smallest).groupBy("root").agg(F.min("_text").alias("_first")), "first")
    judged = found.join(first, "root").select("doc_id", "_text", (smallest & (F.col("_text") == F.col("_first"))).alias("stays"))
    pairs = judged.groupBy(F.col("doc_id").alias("__id"), F.col("_text").alias("__text")).agg(F.any_value("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    # Ids and hashes only: the texts themselves are not shuffled while these are few.
    others = staged(pairs.filter("not stays or n > 1"), "others")
    few = others.count() <= BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text"))
    kept = docs.join(F.broadcast(others) if few else others, same, "left_anti")
    repeated = others.filter("stays")
    if repeated.isEmpty():
        return kept
    row = F.col("__row")
    best = carried(docs).join(repeated.drop("stays", "n").withColumnsRenamed({"__id": "__a", "__text": "__b"}), F.col("__id").eqNullSafe(F.col("__a")) & (F.col("__text") == F.col("__b")))
    best = best.groupBy("__id", "__text").agg(F.any_value(row).alias("__row"))
    return kept.unionByName(unpacked(best, docs))
