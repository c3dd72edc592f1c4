"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_ids(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids, first by hash; an id counts once, with its largest label."""
    return (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, _text, text, label) of the documents of ``labelled_ids``.

    The sample has a fixed bound, so it is broadcast; the texts are met in one scan.
    ``_text`` is a hash of the text. Ids that repeat in ``docs`` bring all their rows:
    see ``one_each``.
    """
    some = F.broadcast(labelled_ids(labels, label, rows))
    return docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", F.xxhash64("text").alias("_text"), "text", "label")


def one_each(rows: DataFrame) -> DataFrame:
    """One row per doc_id, that of the smallest ``_text``; partial minima in the tasks first."""
    rest = [c for c in rows.columns if c not in ("doc_id", "_text")]
    return rows.groupBy("doc_id").agg(F.min(F.struct("_text", *rest)).alias("r")).select("doc_id", *[f"r.{c}" for c in rest])
