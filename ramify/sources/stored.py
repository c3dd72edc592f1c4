"""A labelled or laid-out table stored for lookups by id.

The table is cut into buckets of the id's hash, one file each, sorted by id. Joins on the
id read the node side as it lies: only the requests are shuffled, however large the
hierarchy, and a filter on an id opens one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def store_for_lookup(labelled: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write ``labelled`` as ``table`` of the session's catalog, its files under ``path``; returns it.

    ``path`` must be shared by all executors. ``buckets`` should hold a few hundred MB each;
    by default there are as many as shuffle partitions. With fewer, Spark may prefer to
    shuffle both sides. Ids must be unique, as ``label_hierarchy`` asks; null ids share a
    bucket and meet no request. An existing ``table`` is replaced; an empty one stays empty.
    """
    spark = labelled.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # One task per bucket, so that a bucket is one file and its order survives.
    placed = labelled.repartition(buckets, "id")
    placed.write.format("parquet").mode("overwrite").option("path", path).bucketBy(buckets, "id").sortBy("id").saveAsTable(table)
    return spark.table(table)
