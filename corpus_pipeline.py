"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. The
first four return documents with the columns they came with; packing returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.llm import decontaminate, line_dedup, packing, simhash, toxicity
from ramify.llm.catalog import table, tokenizer_path
from ramify.llm.labelled import remainder
from ramify.store import scratch_path


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in small batches, unless the application was started with its own sizes."""
    own = spark.sparkContext.getConf()
    for name, size in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not own.contains(f"spark.sql.execution.arrow.{name}"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", size)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from the labels outside the held-out fold."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document or line has.

    n_chars follows the text. A document whose lines all go stays, with an empty text.
    """
    _small_batches(spark)
    cleaned = line_dedup.dedup_lines(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", changed.alias("n_chars")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    _small_batches(spark)
    return simhash.drop_near_duplicates(docs, radius=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids."""
    _small_batches(spark)
    packed = packing.pack(docs, tokenizer_path(), capacity=4096, end_id=2)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

# The first stage applies a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        result = stage(spark, docs, sf_dir)
        schema = result.schema
        result.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return docs
