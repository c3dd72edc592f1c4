"""Exact top-k inner products by tiles.

Vectors are packed into blocks of rows; a tile is one block of queries times one block
of candidates, a matrix product from which each query keeps its k best. Partial lists
are merged inside the task, then per query and bucket, then per query. Every query
block meets every candidate block once, as rows of an equi-join on the query block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.llm.staging import staged

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
_EXACT = float(1 << 53)  # integers up to here are exact in a double


def _blocks(vectors: DataFrame, rows: int, key: str | None) -> DataFrame:
    """Vectors (id, v, optional key) packed per task: (key, dim, ids, matrix)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[tuple[int, int], list] = {}
        fields = ["block", "dim", "ids", "matrix"]

        def packed(at: tuple[int, int], items: list) -> pa.RecordBatch:
            ids = np.array([i for i, _ in items], "<i8")
            order = np.argsort(ids, kind="stable")
            matrix = np.array([items[i][1] for i in order], "<f8").reshape(len(items), at[1])
            row = [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([ids[order].tobytes()]), pa.array([matrix.tobytes()])]
            return pa.RecordBatch.from_arrays(row, names=fields)

        for batch in batches:
            blocks = batch.column(2).to_pylist()
            bounds = batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy(zero_copy_only=False)
            for i, number in enumerate(batch.column(0).to_pylist()):
                at = (blocks[i], int(bounds[i + 1] - bounds[i]))
                items = open_blocks.setdefault(at, [])
                items.append((number, values[bounds[i] : bounds[i + 1]]))
                if len(items) == rows:
                    yield packed(at, open_blocks.pop(at))
        for at, items in open_blocks.items():
            yield packed(at, items)

    block = F.col(key) if key else F.lit(0).cast("bigint")
    return vectors.select("id", "v", block.alias("block")).mapInArrow(work, "block bigint, dim bigint, ids binary, matrix binary")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of the k best of each row: highest score, then smallest id (``ids`` ascending).

    The k-th score comes from a partial selection; of those that equal it the first stay.
    """
    chosen = []
    k = min(k, scores.shape[1])
    limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    for row, low in zip(scores, limit):
        above = np.flatnonzero(row > low)
        level = np.flatnonzero(row == low)[: k - len(above)]
        both = np.concatenate([above, level])
        chosen.append(both[np.lexsort((ids[both], -row[both]))])
    return chosen


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exact: doubles while they can hold every sum."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if most < _EXACT:
        return queries @ candidates.T
    if most < 2.0**62:
        return queries.astype(np.int64) @ candidates.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in candidates], object).T
    if max(map(abs, exact.ravel()), default=0) >= 1 << 63:
        raise OverflowError("an inner product does not fit a 64-bit integer")
    return exact.astype(np.int64)


def top_products(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), id, score: the k highest inner products of each query.

    Both tables have id (bigint) and v (array<double> of whole numbers). A candidate
    with the query's id is left out; ties go to the smaller id. Vectors of another
    length than the query's take no part, nor do rows with a null id, vector or
    component. Rows that repeat an id are candidates each; queries that repeat an id
    share one list. With fewer candidates than k all are returned; empty tables give
    no rows.
    """
    usable = "id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    asked = staged(queries.filter(usable).select("id", "v", F.monotonically_increasing_id().alias("n")), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    query_blocks = _blocks(
        asked.withColumn("block", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("bigint")).repartition("block"), 4 * QUERY_BLOCK, "block"
    ).select("block", "dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    tiles = (
        _blocks(candidates.filter(usable), CANDIDATE_BLOCK, None)
        .drop("block")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        .join(query_blocks, ["block", "dim"])
        .select("q_ids", "q_matrix", "ids", "matrix", "dim")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_matrix, ids, matrix, dim in zip(*[c.to_pylist() for c in batch.columns]):
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                scores = products(np.frombuffer(q_matrix, "<f8").reshape(len(q_ids), dim), np.frombuffer(matrix, "<f8").reshape(len(ids), dim))
                # One more than k, since the query itself may be among them; a repeated id, as often as it stands.
                own = int(np.unique(ids, return_counts=True)[1].max())
                found = [c[ids[c] != q][:k] for q, c in zip(q_ids, best(scores, ids, k + own))]
                query = np.repeat(np.arange(len(q_ids)), [len(c) for c in found])
                column = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[query]), pa.array(ids[column]), pa.array(scores[query, column].astype(np.int64))],
                    names=["query_id", "id", "score"],
                )

    partial = tiles.mapInArrow(work, "query_id bigint, id bigint, score bigint")
    order = [F.col("score").desc(), F.col("id")]
    in_bucket = Window.partitionBy("query_id", "bucket").orderBy(*order)
    per_bucket = (
        partial.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(16)))
        .withColumn("rank", F.row_number().over(in_bucket))
        .filter(F.col("rank") <= k)
        .drop("bucket", "rank")
    )
    return (
        per_bucket.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", steps: int = 256) -> DataFrame:
    """(id, v): every component x as floor(steps * x), x as double.

    Vectors that are null or hold null, NaN or infinite components are left out.
    """
    fine = F.col(vector_column).isNotNull() & ~F.exists(
        vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))
    )
    whole = F.transform(vector_column, lambda x: F.floor(x.cast("double") * steps).cast("double"))
    return vectors.filter(fine).select(F.col(id_column).cast("bigint").alias("id"), whole.alias("v"))
