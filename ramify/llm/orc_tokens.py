"""Token ids in ORC: sorted by document id, with row indexes and Bloom filters.

ORC stores the id lists with integer run-length encoding. Files hold consecutive
ranges of doc_id, stripes can be read apart, and a search by doc_id skips files,
stripes and row groups by their statistics and the Bloom filter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ramify.llm.staging import staged
from ramify.llm.tokens import word_encoder

DOCUMENTS_PER_BATCH = 256
ROW_GROUP = 1_000  # rows between entries of the row index
_POSITION_BITS = 33  # below the partition number in monotonically_increasing_id()


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, stripe_bytes: int = 64 << 20) -> None:
    """Write the ids of every whole text to ORC under ``path``, ascending by doc_id.

    Columns: doc_id, ids (array of int, the end id last), slice (number of the file's
    range) and pos (row in the range). Rows that share a doc_id are all written and may
    be spread over ranges; a null doc_id comes first; a null or empty text is the end
    id alone; other columns are ignored; an empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCUMENTS_PER_BATCH):
                part = batch.slice(at, DOCUMENTS_PER_BATCH)
                encoded = [encoder.encode(text) + end for text in part.column(1).to_pylist()]
                bounds = np.zeros(len(encoded) + 1, np.int32)
                np.cumsum([len(e) // 4 for e in encoded], out=bounds[1:])
                ids = np.frombuffer(b"".join(encoded), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, part.column(2), part.column(3)], names=["doc_id", "ids", "slice", "pos"]
                )

    row = F.monotonically_increasing_id()
    ordered = (
        docs.select("doc_id", "text", row.alias("_tie"))
        .repartitionByRange("doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text", row.alias("_row"))
        .select(
            "doc_id",
            "text",
            F.shiftright("_row", _POSITION_BITS).alias("slice"),
            F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("pos"),
        )
    )
    (
        ordered.mapInArrow(work, f"doc_id {kind}, ids array<int>, slice bigint, pos bigint")
        .write.option("compression", "zstd")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids`` only those, found by statistics and Bloom filter."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(list(doc_ids)))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, slice, pos, n_tokens and the crc32 of the ids as unsigned 32-bit integers."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds = lists.offsets.to_numpy().astype(np.int64) * 4
            ids = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(bounds) // 4), pa.array(crcs, pa.int64())],
                names=["doc_id", "slice", "pos", "n_tokens", "ids_crc32"],
            )

    return rows.select("doc_id", "slice", "pos", "ids").mapInArrow(
        work, f"doc_id {kind}, slice bigint, pos bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_starts(digests: DataFrame) -> DataFrame:
    """Adds start: the number of ids in all rows before, in the order of the files.

    Each slice sums its own rows; one row per slice carries what lies before it.
    """
    digests = staged(digests, "digests")
    slices = digests.groupBy("slice").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select("slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        digests.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(F.broadcast(before), "slice")
        .select("*", (F.col("_before") + F.col("_inside")).alias("start"))
        .drop("_before", "_inside")
    )
