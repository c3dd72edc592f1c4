"""Intermediate tables.

Loops and global ranks need a fixed copy of a DataFrame: it cuts the lineage
and pins partition contents. The copy is a Parquet table in the shared folder
named by ``spark.checkpoint.dir``, so it survives the loss of executors and
keeps column pruning and size statistics for the joins that read it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession

_local_roots: dict[str, str] = {}
# Open ``transient`` blocks of this thread or task, outermost first.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("ramify_scopes", default=())
_on_release: list[Callable[[str], None]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not be visible to the executors.
    """
    app = spark.sparkContext.applicationId
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/ramify/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="ramify-")
    return _local_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def transient(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables written inside are dropped at the end, unless kept."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in mine:
            drop_path(spark, path)


def on_release(forget: Callable[[str], None]) -> None:
    """``forget`` is called with the application id when its tables are dropped."""
    _on_release.append(forget)


def release(spark: SparkSession) -> None:
    """Drop every intermediate table of this application, and what refers to one."""
    drop_path(spark, scratch_root(spark))
    for forget in _on_release:
        forget(spark.sparkContext.applicationId)


def materialize(df: DataFrame, label: str, observe: dict | None = None, keep: bool = False):
    """Write ``df`` as an intermediate table and read it back.

    With ``observe`` (name -> aggregate Column) the metrics are gathered by the
    write itself and returned as a second value. ``keep`` lets the table outlive
    the innermost ``transient`` block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    scopes = _scopes.get()
    if scopes and not keep:
        scopes[-1].append(path)
    elif keep and len(scopes) > 1:
        scopes[-2].append(path)
    schema = df.schema
    if observe is None:
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path)
    seen = Observation(f"{label}-{uuid.uuid4().hex}")
    df.observe(seen, *[c.alias(n) for n, c in observe.items()]).write.parquet(path)
    return spark.read.schema(schema).parquet(path), seen.get
