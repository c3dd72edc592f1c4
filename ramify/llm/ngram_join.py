"""Documents joined on the Jaccard similarity of their word n-grams, by count-vector R-trees.

A document is the set of its distinct shingles, kept as 64-bit hashes. Equal sets are one
class. A class is a point: how many of its shingles fall in each of GROUPS groups. R-trees
over these points bound the overlap of two sets by the sum of the smaller counts; pairs
that survive are verified by the shingles themselves.

One tree of all classes, searched with all classes, would cost the square of the input.
So classes are first dealt to families outside which they cannot have a link. Two sets
with a link differ in a bounded number d of shingles; their shingles, cut into d + 2 parts
by hash, are the same in two parts at least. A class gives one key for every part that has
LEAST_IN_PART shingles, and one for every two parts that have fewer, so that any two linked
classes share a key; d depends on a bound of the larger size, of which a class uses one
or two. Classes that share keys, directly or through others, are a family. Families above
PAGE shingles are cut into pages by size, and a pair of pages is a task of its own unless
the bound over both pages' largest counts rules it out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.llm.bktree import join_labels
from ramify.llm.components import connected_components
from ramify.llm.rtree import RTree, least_overlap
from ramify.llm.staging import staged
from ramify.llm.tiles import whole_tiles
from ramify.operators.ranking import grouped_running

SHINGLE = 3
PERCENT = 90
GROUPS = 32
LEAST_IN_PART = 3
PAGE = 1 << 19  # shingles
SMALLEST = 8  # bounds of sizes: from this on, each half as large again
BROADCAST_ROWS = 1_000_000
DOCUMENTS_PER_BATCH = 512
MOST_WORDS = 400_000  # whose hashes a worker remembers

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number depends on all of them."""
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        digest = xxh64_intdigest(word, seed=13)
        if len(word) <= 64:
            self[word] = digest
        return digest


_hashes = _WordHashes()


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text, A-Z in lower case.

    Fewer words than ``shingle`` are one shingle; no words give an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_hashes) > MOST_WORDS:
        _hashes.clear()
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total * _ODD[0] + each[i : len(each) - width + 1 + i] * _ODD[1])
    return np.unique(total)


@cache
def most_different(largest: int, percent: int) -> int:
    """Shingles that are in one of two linked sets only, at most, if none is above ``largest``."""
    totals = np.arange(max(0, 2 * largest - 200), 2 * largest + 1)
    return int((totals - 2 * least_overlap(totals, percent)).max())


def size_bounds(n: int, percent: int) -> list[int]:
    """Upper bounds of the larger size under which a set of ``n`` shingles meets its partners."""
    bound = SMALLEST
    while bound < n:
        bound += bound // 2
    found = [bound]
    while 100 * n >= percent * (found[-1] + 1):
        found.append(found[-1] + found[-1] // 2)
    return found


def part_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of which any two linked sets that are not equal share one."""
    found = [np.empty(0, np.uint64)]
    for bound in size_bounds(len(shingles), percent):
        different = most_different(bound, percent)
        if not different:
            continue
        parts = np.uint64(different + 2)
        part = ((shingles >> np.uint64(32)) * parts >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(part, minlength=int(parts))
        sums = np.zeros(int(parts), np.uint64)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        sums[part[first]] = np.add.reduceat(_mixed(shingles), first)
        label = np.full(int(parts), bound, np.uint64) * _ODD[0] + np.arange(int(parts), dtype=np.uint64) * _ODD[1] + counts.astype(np.uint64)
        keys = _mixed(_mixed(label) + sums)
        found.append(keys[counts >= LEAST_IN_PART])
        weak = keys[counts < LEAST_IN_PART]
        a, b = np.triu_indices(len(weak), 1)
        found.append(_mixed(weak[a] * _ODD[1] + weak[b] * _ODD[2]))
    return np.concatenate(found)


def group_counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, _text (hash of the text), n (size), h1 and h2 (hash of the set), counts, keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in (b.slice(at, DOCUMENTS_PER_BATCH) for b in batches for at in range(0, b.num_rows, DOCUMENTS_PER_BATCH)):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column(1)]
            both = np.frombuffer(b"".join(xxh3_128_digest(s) for s in sets), "<i8").reshape(-1, 2)
            columns = [
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]),
                pa.array([group_counts(s) for s in sets], pa.list_(pa.int32())),
                pa.array([part_keys(s, percent).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_text", "n", "h1", "h2", "counts", "keys"])

    schema = f"doc_id {kind}, _text bigint, n bigint, h1 bigint, h2 bigint, counts array<int>, keys array<bigint>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).mapInArrow(work, schema)


def _few(df: DataFrame) -> DataFrame:
    """A written table with the advice to broadcast it, if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _families(classes: DataFrame) -> DataFrame:
    """(node, family) of the classes that share a key with another."""
    keyed = classes.select("node", F.explode("keys").alias("key"))
    shared = staged(
        keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b <> last").select("key", "b"), "shared"
    )
    edges = keyed.join(_few(shared), "key").select(F.col("node").alias("a"), "b")
    return connected_components(edges).withColumnRenamed("root", "family")


def _tiles(families: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(family, low, high, page, node): which classes meet in which task, each two of a family once."""
    sized = families.join(classes.select("node", "n", "counts"), "node")
    paged = staged(
        grouped_running(sized, ["family"], ["n", "node"], "nr", {"before": F.col("n")})
        .select("family", "node", "n", "counts", F.floor((F.col("before") - F.col("n")) / PAGE).cast("int").alias("page")),
        "paged",
    )
    high = F.array(*[F.max(F.col("counts")[i]) for i in range(GROUPS)]).alias("high")
    pages = staged(paged.groupBy("family", "page").agg(high, F.min("n").alias("small"), F.max("n").alias("large")), "pages")
    a = pages.select("family", F.col("page").alias("low"), F.col("high").alias("high_a"), "large")
    b = pages.select("family", F.col("page").alias("high"), F.col("high").alias("high_b"), "small")
    # Sizes rise with the pages: the sets of a are the smaller ones.
    shared = F.aggregate(F.zip_with("high_a", "high_b", lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    near = (F.col("low") <= F.col("high")) & (F.col("large") * 100 >= F.col("small") * percent) & (shared * 100 >= F.col("small") * percent)
    pairs = a.join(b, "family").filter(near).select("family", "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("page"))
    return paged.select("family", "page", "node", "n", "counts").join(pairs, ["family", "page"])


def linked(tile: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) of a tile's rows that are linked, each pair once.

    Columns low, high, page, n, counts and shingles (packed hashes).
    """
    low, high, page = (tile.column(c)[0].as_py() if c != "page" else tile.column(c).to_numpy() for c in ("low", "high", "page"))
    sizes = tile.column("n").to_numpy().astype(np.int64)
    points = np.stack(tile.column("counts").to_numpy()).astype(np.int64)
    queries, items = np.flatnonzero(page == high), np.flatnonzero(page == low)
    shingles = np.frombuffer(b"".join(tile.column("shingles").to_pylist()), np.uint64)
    _, ids = np.unique(shingles, return_inverse=True)
    ends = np.cumsum(sizes)
    tree = RTree(points[items], sizes[items])
    mark = np.zeros(len(ids), bool)
    found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for query, item in tree.candidates(points[queries], sizes[queries], percent):
        query, item = queries[query], items[item]
        if low == high:
            query, item = query[query < item], item[query < item]
        order = np.argsort(query, kind="stable")
        query, item = query[order], item[order]
        cuts = np.flatnonzero(np.diff(query, prepend=-1))
        for q, others in zip(query[cuts], np.split(item, cuts[1:])):
            mine = ids[ends[q] - sizes[q] : ends[q]]
            mark[mine] = True
            theirs = np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in others])
            common = np.add.reduceat(mark[theirs].astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
            mark[mine] = False
            fits = (100 + percent) * common >= percent * (sizes[q] + sizes[others])
            found_a.append(np.full(fits.sum(), q))
            found_b.append(others[fits])
    return np.concatenate(found_a), np.concatenate(found_b)


def links(docs: DataFrame, classes: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b, links): per class a, from each of its tasks, a linked class b that joins up its
    component, and the number of documents linked there.

    ``classes`` has node, first (doc_id and text hash of one of its documents), n, copies,
    counts and keys.
    """
    families = staged(_families(classes), "families")
    tiles = staged(_tiles(families, classes, percent), "tiles")
    wanted = staged(
        classes.join(families.select("node"), "node", "left_semi").select("node", "copies", F.col("first.doc_id").alias("__id"), F.col("first._text").alias("__text")),
        "wanted",
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64("text").eqNullSafe(F.col("__text"))
    texts = docs.select("doc_id", "text").join(_few(wanted), same).select("node", "copies", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DOCUMENTS_PER_BATCH) for b in batches for at in range(0, b.num_rows, DOCUMENTS_PER_BATCH)):
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["node", "copies", "shingles"])

    sets = staged(texts.mapInArrow(hashed, "node bigint, copies bigint, shingles binary").dropDuplicates(["node"]), "sets")
    key = ["family", "low", "high"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in whole_tiles(batches, key):
            node, copies = tile.column("node").to_numpy(), tile.column("copies").to_numpy()
            a, b = linked(tile, percent)
            if not len(a):
                continue
            labels = join_labels(np.arange(len(node)), a, b)
            weight = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[some]), pa.array(node[labels[some]]), pa.array(weight[some].astype(np.int64))], names=["a", "b", "links"]
            )

    rows = tiles.join(sets, "node").select(*key, "page", "node", "n", "copies", "counts", "shingles")
    return rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(work, "a bigint, b bigint, links bigint")


def jaccard_join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links; also class_id.

    Two documents are linked when the Jaccard similarity of their sets of ``shingle``
    words is ``percent`` hundredths or more. component_id is the smallest doc_id that links
    lead to, the document's own included; n_links counts the other documents it is linked
    with, copies included. Documents of equal sets have one class_id.

    Null, empty and word-free texts have no shingles, no links and no class_id. A null
    doc_id is no component_id, unless a component has no other. Repeated rows are
    returned each and are linked with each other; an empty table gives no rows; other
    columns are ignored. Shingles are told apart by 64-bit hashes.
    """
    sets = staged(shingle_sets(docs, shingle, percent), "sets")
    classes = staged(
        sets.filter("n > 0").groupBy("h1", "h2")
        .agg(
            F.min(F.struct("doc_id", "_text")).alias("first"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"),
            F.any_value("n").alias("n"), F.any_value("counts").alias("counts"), F.any_value("keys").alias("keys"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    found = staged(links(docs, classes, shingle, percent), "links")
    roots = connected_components(found.select("a", "b"))
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = staged(
        classes.select("h1", "h2", "node", "least", "copies").join(roots, "node", "left").join(counted, "node", "left")
        .withColumn("root", F.coalesce("root", "node")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1),
        "named",
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = staged(named.join(smallest, "root").select("h1", "h2", F.col("node").alias("class_id"), "component_id", "links"), "by_class")
    rows = sets.select("doc_id", "n", "h1", "h2")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(None).cast("bigint").alias("class_id"))
    met = rows.filter("n > 0").join(by_class, ["h1", "h2"])
    return met.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("links").alias("n_links"), "class_id").unionByName(alone)
