"""Ranks and running sums that never put a whole group in one task.

``row_number() OVER (ORDER BY ...)`` runs in one task, and ``PARTITION BY key``
puts a key that holds a third of the rows in one task. Here the rows are range
partitioned and sorted on a total order instead. Each sorted slice numbers its
own rows; the slice totals (one row per slice) give the offsets.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ramify.store import materialize

# Bits below the partition number in monotonically_increasing_id().
_POSITION_BITS = 33

ColumnLike = Column | str


def _cols(items: Sequence[ColumnLike]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in items]


def sorted_slices(df: DataFrame, order: Sequence[ColumnLike], label: str = "slices") -> DataFrame:
    """Range-sorted copy of ``df`` with ``_slice`` and ``_pos`` (0-based in the slice).

    ``order`` must be a total order, so that equal keys can be split too.
    """
    cols = _cols(order)
    row = F.monotonically_increasing_id()
    numbered = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_row", row)
        .withColumn("_slice", F.shiftright("_row", _POSITION_BITS).cast("int"))
        .withColumn("_pos", F.col("_row").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_row")
    )
    return materialize(numbered, label)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, first = None, True
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if held is not None:
            n, last = held.num_rows, batch is None
            marks = [pa.array([first] + [False] * (n - 1)), pa.array([False] * (n - 1) + [last])]
            yield pa.RecordBatch.from_arrays([*held.columns, *marks], names=[*held.schema.names, "_first", "_last"])
            first = False
        held = batch


def mark_ends(df: DataFrame) -> DataFrame:
    """Rows where they are, with ``_first`` and ``_last`` of their partition."""
    marks = [StructField("_first", BooleanType()), StructField("_last", BooleanType())]
    return df.mapInArrow(_ends, StructType([*df.schema.fields, *marks]))


def slice_offsets(slices: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Exclusive running totals over slices: one row per slice, safe to broadcast."""
    per_slice = slices.groupBy("_slice").agg(*[c.alias(n) for n, c in totals.items()])
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        "_slice", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )


def global_rank(df: DataFrame, order: Sequence[ColumnLike], rank_col: str) -> DataFrame:
    """1-based dense position of every row in the total order ``order``."""
    slices = sorted_slices(df, order, f"rank-{rank_col}")
    offsets = slice_offsets(slices, {"_before": F.count(F.lit(1))})
    return (
        slices.join(F.broadcast(offsets), "_slice")
        .withColumn(rank_col, F.col("_before") + F.col("_pos") + 1)
        .drop("_slice", "_pos", "_before")
    )


def grouped_running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[ColumnLike],
    rank_col: str,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Rank (1-based) and inclusive running sums inside each group.

    A group larger than a slice is continued in the next slice: the carried
    count comes from a table with at most one row per slice boundary.
    """
    sums = sums or {}
    for name, value in sums.items():
        df = df.withColumn(f"_v_{name}", value)
    slices = sorted_slices(df, [*group, *order], f"grouped-{rank_col}")
    pieces = slices.groupBy("_slice", *group).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums]
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = pieces.select(
        "_slice",
        *[F.col(g).alias(f"_g_{g}") for g in group],
        F.sum("_n").over(earlier).alias("_carry"),
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
    ).filter(F.col("_carry") > 0)
    match = F.col("s._slice") == F.col("c._slice")
    for g in group:
        match = match & F.col(f"s.{g}").eqNullSafe(F.col(f"c._g_{g}"))
    inside = Window.partitionBy("_slice", *group).orderBy("_pos")
    local = slices.withColumn("_local", F.row_number().over(inside))
    for n in sums:
        local = local.withColumn(f"_l_{n}", F.sum(f"_v_{n}").over(inside))
    joined = local.alias("s").join(F.broadcast(carried).alias("c"), match, "left")
    keep = [c for c in df.columns if not c.startswith("_v_")]
    return joined.select(
        *[F.col(f"s.{c}") for c in keep],
        (F.col("_local") + F.coalesce("_carry", F.lit(0))).cast("bigint").alias(rank_col),
        *[(F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def top_k(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[ColumnLike],
    k: int | Column,
    rank_col: str,
    spread: str,
    buckets: int = 64,
) -> DataFrame:
    """First ``k`` rows of every group in the total order ``order``.

    A first pass ranks inside (group, bucket of ``spread``), so no task sees a
    whole large group; the second pass sees at most ``k`` rows per bucket.
    """
    cols = _cols(order)
    limit = F.lit(k) if isinstance(k, int) else k
    by_bucket = Window.partitionBy(*group, "_bucket").orderBy(*cols)
    first = (
        df.withColumn("_bucket", F.pmod(F.xxhash64(spread), F.lit(buckets)))
        .withColumn("_first", F.row_number().over(by_bucket))
        .filter(F.col("_first") <= limit)
        .drop("_bucket", "_first")
    )
    whole = Window.partitionBy(*group).orderBy(*cols)
    return first.withColumn(rank_col, F.row_number().over(whole)).filter(F.col(rank_col) <= limit)
