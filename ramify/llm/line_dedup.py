"""Line dedup by a deletion-neighbourhood join.

Two lines at most d edits apart become equal after at most d deletions in each. So a
line emits all its variants with up to d characters deleted, as hashed keys; lines that
share a key are compared, and a line goes if an earlier one lies within d edits.

A line of n characters has n variants for d = 1, too many to shuffle for every line of
a corpus. But one edit leaves all other segments of a line as they were. So lines first
emit one key per segment, made of all that stands before and after it, in two steps: of
two segments for all lines, then of SEGMENTS for the lines that share one of those.
Variants are emitted for deletions inside segments whose key another line has, and no
pair is lost by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.llm.staging import carried, staged, unpacked

MAX_EDITS = 1
MIN_CHARS = 20
SEGMENTS = 8
DOCUMENTS_PER_BATCH = 512
BROADCAST_ROWS = 4_000_000  # of 64-bit keys; more are joined by shuffle
_PLACE = ["doc_id", "_text", "line_no"]
_LINE = ["h1", "h2"]

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def normalised(line: bytes) -> bytes:
    """A-Z in lower case, runs of white space as one space, none at the ends."""
    return b" ".join(line.lower().split())


def segment_keys(line: str, segments: int) -> list[tuple[int, int, int]]:
    """(key, first, last) for each segment: a hash of all around it, and its characters.

    With g = n // segments, segment i follows the first i * g characters and precedes the
    last (segments - 1 - i) * g. A line of n characters uses the g of n and of n - 1, so
    that lines one character apart share one division.
    """
    from xxhash import xxh64_intdigest

    n, found = len(line), []
    for g in {n // segments, (n - 1) // segments}:
        for i in range(segments):
            first, last = i * g, n - (segments - 1 - i) * g
            around = f"{segments} {i} {g} {line[:first]}\n{line[last:]}"
            found.append((xxh64_intdigest(around.encode("utf-8", "surrogatepass")) - (1 << 63), first, last))
    return found


def deletion_keys(line: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Hashes of the line and of its variants without one character of ``spans``.

    A polynomial hash modulo 2^64: what lies after the deleted character moves down by
    one place, which is a product with the inverse of the base.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers)])
    at = np.unique(np.concatenate([np.empty(0, np.int64), *[np.arange(a, b) for a, b in spans]])).astype(np.int64)
    shorter = sums[at] + (sums[-1] - sums[at + 1]) * np.uint64(_INVERSE)
    keys = np.unique(np.append(shorter, sums[-1]))
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def all_deletion_keys(line: Column, edits: int) -> Column:
    """Hashes of the line with up to ``edits`` characters deleted, anywhere."""
    texts = F.array(line)
    for _ in range(edits):
        shorter = F.transform(
            texts,
            lambda t: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1))
            ),
        )
        texts = F.array_distinct(F.concat(texts, F.flatten(shorter)))
    return F.transform(texts, lambda t: F.xxhash64(t))


def document_lines(docs: DataFrame, min_chars: int, keys: bool, lines: bool) -> DataFrame:
    """doc_id, _text, line_no (from 0), h1 and h2 of the normalised lines that take part.

    With ``keys`` also halves, the keys of two segments; with ``lines`` the line itself.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in (b.slice(at, DOCUMENTS_PER_BATCH) for b in batches for at in range(0, b.num_rows, DOCUMENTS_PER_BATCH)):
            rows, numbers, digests, halves, kept = [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                for number, raw in enumerate(text.as_py().encode("utf-8", "surrogatepass").split(b"\n")):
                    if len(raw) < min_chars:
                        continue
                    plain = normalised(raw)
                    line = plain.decode("utf-8", "surrogatepass") if keys or lines or not plain.isascii() else plain
                    if len(line) < max(min_chars, 1):
                        continue
                    rows.append(row)
                    numbers.append(number)
                    digests.append(xxh3_128_digest(plain))
                    if keys:
                        halves.append([k for k, _, _ in segment_keys(line, 2)])
                    if lines:
                        kept.append(line)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            found = batch.select([0, 1]).take(pa.array(rows, pa.int64()))
            columns = [*found.columns, pa.array(numbers, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])]
            names = [*_PLACE, *_LINE]
            if keys:
                columns.append(pa.array(halves, pa.list_(pa.int64())))
                names.append("halves")
            if lines:
                columns.append(pa.array(kept, pa.string()))
                names.append("line")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("_text"), "text")
    more = ", halves array<bigint>" * keys + ", line string" * lines
    return rows.mapInArrow(work, f"doc_id {kind}, _text bigint, line_no int, h1 bigint, h2 bigint{more}")


def _matching(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among ``keys``, a written table of distinct keys: broadcast if few."""
    few = keys.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys) if few else keys, on, "left_semi")


def repeated_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, _text, line_no of the lines that an earlier line makes superfluous.

    Lines are compared in the order of doc_id, text hash and number; nulls come first.
    """
    place = F.struct(*_PLACE)
    one = max_edits == 1
    lines = staged(document_lines(docs, min_chars, keys=one, lines=False), "lines")
    distinct = staged(lines.groupBy(*_LINE).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    judged = distinct.filter("n > 1").select(*_LINE, "first")
    if max_edits:
        near = _near(docs, lines, distinct, max_edits, min_chars).withColumn("near", F.lit(True))
        judged = judged.join(near, _LINE, "full").select(*_LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    else:
        judged = judged.withColumn("near", F.lit(False))
    # A line with a near, earlier one goes wherever it stands; of others the first stays.
    return lines.join(judged, _LINE).filter(F.col("near") | ~place.eqNullSafe(F.col("first"))).select(*_PLACE)


def _candidates(docs: DataFrame, lines: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(h1, h2, key), the deletion keys of lines that may have a partner, and their texts."""
    halves = lines.select("h1", F.explode("halves").alias("half"))
    shared = staged(
        halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half"), "halves"
    )
    partnered = staged(_matching(halves, shared, ["half"]).select("h1").distinct(), "partnered")
    texts = _matching(document_lines(docs, min_chars, keys=False, lines=True), partnered, ["h1"])
    texts = staged(texts.groupBy(*_LINE).agg(F.any_value("line").alias("line")), "texts")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, firsts, lasts = [], [], [], []
            for row, line in enumerate(batch.column(2)):
                for key, first, last in segment_keys(line.as_py(), SEGMENTS):
                    rows.append(row)
                    keys.append(key)
                    firsts.append(first)
                    lasts.append(last)
            found = batch.select(_LINE).take(pa.array(rows, pa.int64()))
            columns = [*found.columns, pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_LINE, "segment", "a", "b"])

    parts = staged(texts.mapInArrow(segments, "h1 bigint, h2 bigint, segment bigint, a int, b int"), "segments")
    common = staged(
        parts.groupBy("segment").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).filter("x <> y").select("segment"), "common"
    )
    spans = _matching(parts, common, ["segment"]).groupBy(*_LINE).agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys = [
                    deletion_keys(line.as_py(), [(s["a"], s["b"]) for s in spans.as_py()])
                    for line, spans in zip(part.column(2), part.column(3))
                ]
                rows = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                found = part.select(_LINE).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.concatenate(keys))], names=[*_LINE, "key"])

    return texts.join(spans, _LINE).select(*_LINE, "line", "spans").mapInArrow(variants, "h1 bigint, h2 bigint, key bigint"), texts


def _near(docs: DataFrame, lines: DataFrame, distinct: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the lines that have another, earlier one within ``max_edits``.

    Lines that share a key are at most 2 * max_edits apart, not always max_edits, so
    pairs are verified. For one line it is enough to find one earlier line, and the
    earliest of a key is tried first: most lines of a large group are settled by it.
    Those that are not are compared with the others of their keys.
    """
    if max_edits == 1:
        variants, texts = _candidates(docs, lines, min_chars)
    else:
        texts = document_lines(docs, min_chars, keys=False, lines=True).groupBy(*_LINE).agg(F.any_value("line").alias("line"))
        texts = staged(texts, "texts")
        variants = texts.select(*_LINE, F.explode(all_deletion_keys(F.col("line"), max_edits)).alias("key"))
    firsts = distinct.select(*_LINE, "first")
    texts = staged(texts.join(firsts, _LINE), "texts")
    variants = staged(variants, "variants").join(texts.select(*_LINE, "first"), _LINE)
    leaders = (
        variants.groupBy("key")
        .agg(F.min(F.struct("first", *_LINE)).alias("k"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("key", F.col("k.first").alias("o_first"), F.col("k.h1").alias("o1"), F.col("k.h2").alias("o2"))
    )
    led = staged(variants.join(leaders, "key").filter("first > o_first"), "led")
    line = texts.select(*_LINE, "line")
    other = texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("o_line"))
    close = F.levenshtein("line", "o_line", max_edits) >= 0

    def verified(pairs: DataFrame) -> DataFrame:
        return pairs.join(line, _LINE).join(other, ["o1", "o2"]).filter(close).select(*_LINE).distinct()

    by_first = staged(verified(led.select(*_LINE, "o1", "o2").distinct()), "settled")
    unsettled = led.join(by_first, _LINE, "left_anti").select("key", *_LINE, "first")
    earlier = variants.select("key", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("o_first"))
    by_others = verified(unsettled.join(earlier, "key").filter("o_first < first").select(*_LINE, "o1", "o2").distinct())
    return staged(by_first.unionByName(by_others), "near")


def dedup_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without repeated lines, and n_removed, the number of lines taken out.

    A line goes if an earlier line, in the order of doc_id and line number over all
    documents, equals it after normalisation or lies within ``max_edits`` edits
    (insertions, deletions, replacements of characters). Shorter lines than
    ``min_chars`` stay and count for nothing. The first of several equal lines stays, so
    a document keeps what no earlier one has; a document whose lines all go keeps an
    empty text.

    Null texts stay null. Rows with the same doc_id and text count as one document; a
    null doc_id comes first. An empty table stays empty; other columns are kept.
    """
    gone = (
        repeated_lines(docs, max_edits, min_chars)
        .groupBy("doc_id", "_text")
        .agg(F.collect_set("line_no").alias("__gone"))
        .withColumnsRenamed({"doc_id": "__in", "_text": "__in_text"})
    )
    same_row = F.col("__id").eqNullSafe(F.col("__in")) & (F.col("__text") == F.col("__in_text"))
    text = F.col("__row.text")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("__gone", i)), "\n")
    return unpacked(
        carried(docs).join(gone, same_row, "left"),
        docs,
        text=F.when(F.col("__gone").isNull(), text).otherwise(kept),
        n_removed=F.coalesce(F.size("__gone"), F.lit(0)),
    )
