"""Session builder used by the benchmark and the tests."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app_name: str = "ramify",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
    checkpoint_dir: str | None = None,
) -> SparkSession:
    """Create a session with the settings this library is written for.

    Adaptive execution coalesces small shuffles and splits skewed join
    partitions, so only the upper number of shuffle partitions is set here.
    ``checkpoint_dir`` is the shared folder for intermediate tables.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("RAMIFY_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Share out a table stored in fewer files than there are cores.

    Work that is heavy per row would otherwise run in as many tasks as there
    are splits. Tables in many splits are returned as they are, without a shuffle; only
    the number of splits is asked for.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= wanted else df.repartition(wanted)
