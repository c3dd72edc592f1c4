"""Written tables between the steps of an operator, in the session's shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.store import scratch_path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage and pins row order inside files. The copy is shared storage,
    so a lost executor costs no more than the tasks it was running.
    """
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def carried(docs: DataFrame) -> DataFrame:
    """__id, __text (hash of the text) and __row: rows whose own column names cannot clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), row.alias("__row"))


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from __row, those in ``changed`` by their new expression."""
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"__row.`{c}`") for c in docs.columns], *[e.alias(c) for c, e in changed.items() if c not in docs.columns])


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
