"""Harmonic packing of token sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of capacity/k
ids (rounded down), and every sequence of the class takes exactly k of them. A
document gives as many whole sequences as it can; the rest is cut greedily at the
largest class length that still fits, so that a document has a handful of pieces.
Since all pieces of a class are equally long, the place of a piece follows from
its number in the class alone: workers number their own pieces, and one row per
(class, worker) carries the counts of the workers before. No piece is compared
with any other and no class is gathered anywhere, however many documents share it.

The pieces that do not fill the last sequence of their class are at most
capacity/length per class, whatever the input. They are cut at powers of two and
placed the same way; the last sequences of those classes are closed at a power
of two, where nothing is padded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.llm.staging import staged
from ramify.llm.tokens import word_encoder
from ramify.operators.ranking import grouped_running

DOCUMENTS_PER_BATCH = 256
BROADCAST_ROWS = 1_000_000  # of counts per class and worker; more are joined by shuffle


@lru_cache(maxsize=100_000)
def cut(n: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """(start, length) of the pieces of a document of ``n`` ids.

    After the whole sequences, the rest r goes to class k = ceil(capacity / r) with
    its first capacity // k ids, and so on. Up to sqrt(capacity) ids stay in one
    piece: there a whole sequence of equal pieces wastes less than one piece.
    """
    pieces, start = [], 0
    small = int(capacity**0.5)
    while start < n:
        left = n - start
        length = capacity if left >= capacity else left if left <= small else capacity // -(-capacity // left)
        pieces.append((start, length))
        start += length
    return tuple(pieces)


def _pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, numbered per class by the worker that made it."""
    id_field = docs.schema["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        end, seen = struct.pack("<I", end_id), {}
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_PER_BATCH):
                part = batch.slice(at, DOCUMENTS_PER_BATCH)
                rows, starts, lengths, ids, totals, ranks = [], [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    encoded = encoder.encode(text) + end
                    n = len(encoded) // 4
                    for start, length in cut(n, capacity):
                        rank = seen.get(length, 0)
                        seen[length] = rank + 1
                        rows.append(row)
                        starts.append(start)
                        lengths.append(length)
                        ids.append(encoded[4 * start : 4 * (start + length)])
                        totals.append(n)
                        ranks.append(rank)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(totals, pa.int64()),
                        pa.array([worker] * len(rows), pa.int64()),
                        pa.array(ranks, pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "worker", "rank"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        work,
        f"doc_id {id_field.dataType.simpleString()}, start bigint, length bigint, ids binary,"
        " doc_tokens bigint, worker bigint, rank bigint",
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Sequences of at most ``capacity`` ids, a power of two: one row per piece.

    Returns doc_id, start and length of the piece in its document, its ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset in the sequence.
    Sequence numbers and offsets have no gaps.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows
    are packed each; an empty table gives no rows; other columns are ignored. Which
    document takes which place of its class depends on the partitioning of the input.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    pieces = staged(_pieces(docs, tokenizer_path, end_id, capacity), "pieces")

    # Counts per class and worker; then per class: at most 2 * sqrt(capacity) rows.
    counts = pieces.groupBy("length", "worker").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "worker", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    by_length = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = F.expr(f"{capacity} div length")
    classes = staged(
        counts.groupBy("length")
        .agg(F.sum("n").alias("n"))
        .withColumn("full", F.expr(f"n div ({capacity} div length)"))
        .withColumn("first", F.coalesce(F.sum("full").over(by_length), F.lit(0))),
        "classes",
    )
    offsets = staged(before.join(F.broadcast(classes), "length"), "offsets")
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    placed = (
        pieces.join(offsets, ["length", "worker"])
        .withColumn("at", F.col("before") + F.col("rank"))
        .withColumn("bin", F.expr(f"at div ({capacity} div length)"))
    )
    filled = placed.filter("bin < full").select(
        "doc_id", "start", "length", "ids", "doc_tokens",
        (F.col("first") + F.col("bin")).alias("sequence_id"),
        (F.col("at") % per_bin * F.col("length")).alias("offset"),
    )
    return filled.unionByName(_close(placed.filter("bin >= full"), classes, capacity))


def _close(left: DataFrame, classes: DataFrame, capacity: int) -> DataFrame:
    """Places for the pieces that fill no sequence of their class."""
    bits = capacity.bit_length()
    powers = [1 << b for b in reversed(range(bits))]
    # A piece of 13 ids becomes 8 + 4 + 1, longest first.
    cuts = F.filter(
        F.array(*[
            F.struct(
                F.lit(p).cast("bigint").alias("power"),
                (F.col("length") - F.col("length") % (2 * p)).alias("skip"),
                (F.col("length").bitwiseAND(F.lit(p)) != 0).alias("there"),
            )
            for p in powers
        ]),
        lambda c: c["there"],
    )
    parts = left.select("*", F.explode(cuts).alias("c")).select(
        "doc_id", "doc_tokens", "at",
        F.col("length").alias("was"),
        F.col("c.power").alias("power"),
        (F.col("start") + F.col("c.skip")).alias("start"),
        F.expr("substring(ids, cast(4 * c.skip as int) + 1, cast(4 * c.power as int))").alias("ids"),
    )
    numbered = grouped_running(parts, ["power"], ["was", "at", "start"], "number")

    last = F.coalesce(F.sum("sequences").over(Window.orderBy("power").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_all = classes.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]  # one number
    closing = (
        classes.select(
            F.expr(f"n % ({capacity} div length)").alias("open"),
            F.explode(F.transform(cuts, lambda c: c["power"])).alias("power"),
        )
        .groupBy("power")
        .agg(F.sum("open").alias("n"))
        .withColumn("whole", F.expr(f"n div ({capacity} div power)"))
        .withColumn("rest", F.expr(f"n % ({capacity} div power)"))
        .withColumn("sequences", F.col("whole") + F.bit_count("rest"))
        .select("power", "whole", "rest", (last + F.lit(before_all)).alias("first"))
    )
    # The rest of a class, m pieces, is closed in sequences of 2^b pieces for the bits b
    # of m. Piece i lies in the one of the highest bit where i and m differ.
    return (
        numbered.join(F.broadcast(closing), "power")
        .withColumn("i", F.col("number") - 1)
        .withColumn("bin", F.expr(f"i div ({capacity} div power)"))
        .withColumn("i", F.expr(f"i % ({capacity} div power)"))
        .withColumn("bit", F.length(F.bin(F.col("rest").bitwiseXOR(F.col("i")))) - 1)
        .withColumn("above", F.expr("shiftleft(shiftright(rest, bit + 1), bit + 1)"))
        .select(
            "doc_id", "start",
            F.col("power").alias("length"),
            "ids", "doc_tokens",
            (F.col("first") + F.col("bin") + F.when(F.col("bin") < F.col("whole"), 0).otherwise(F.bit_count("above"))).alias("sequence_id"),
            (F.when(F.col("bin") < F.col("whole"), F.col("i")).otherwise(F.col("i") - F.col("above")) * F.col("power")).alias("offset"),
        )
    )
