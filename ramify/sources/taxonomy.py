"""Readers for taxonomy dumps: delimited text in, typed tables out.

Each reader keeps ``line_no``: where an id is repeated the last line wins, and
among synonyms of equal length the first one does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.functions import text as T

_BAR = r"\t\|\t"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_no, is_first, value). ``line_no`` orders lines by file, block and row."""
    row = F.monotonically_increasing_id()
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), row.alias("_row")
    )
    # A task may read several files: the first line of each is the least row of its first block.
    first = lines.filter("_start = 0").groupBy("_file").agg(F.min("_row").alias("_first"))
    return lines.join(first, "_file", "left").select(
        F.struct("_file", "_start", "_row").alias("line_no"),
        F.coalesce((F.col("_start") == 0) & (F.col("_row") == F.col("_first")), F.lit(False)).alias("is_first"),
        "value",
    )


def _fields(value: Column, least: int) -> Column:
    """Split at tab-bar-tab; with too few fields, at plain tabs."""
    wide = F.split(value, _BAR)
    return F.when(F.size(wide) < least, F.split(value, r"\t")).otherwise(wide)


def _header(value: Column, first_word: str) -> Column:
    """Only the very first line may be a header: the word, '#' or blank."""
    looks = value.startswith(first_word) | value.startswith("#") | (T.strip(value) == "")
    return F.col("is_first") & looks


def _last_line_wins(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    latest = F.max_by(F.struct(*columns, "line_no"), F.col("line_no"))
    return rows.groupBy(key).agg(latest.alias("_r")).select(key, *[f"_r.{c}" for c in columns], "_r.line_no")


def parse_opentree_taxonomy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, rejected lines) from lines with (line_no, is_first, value)."""
    body = lines.filter(~_header(F.col("value"), "ott_id"))
    f = body.withColumn("_f", _fields(F.col("value"), 4))
    node_id = T.parse_int(T.strip(F.get("_f", F.lit(0))))
    parent = T.strip(F.get("_f", F.lit(1)))
    # A parent that is no number could never be found: such a row is not a root.
    ok = (F.size("_f") >= 4) & node_id.isNotNull() & ((parent == "") | T.parse_int(parent).isNotNull())
    nodes = f.filter(ok).select(
        node_id.alias("id"),
        T.parse_int(parent).alias("parent_id"),
        T.default_name(F.get("_f", F.lit(2)), T.strip(F.get("_f", F.lit(0)))).alias("name"),
        T.default_rank(F.get("_f", F.lit(3))).alias("rank"),
        "line_no",
    )
    rejected = f.filter(~F.coalesce(ok, F.lit(False))).select("line_no", "value")
    return _last_line_wins(nodes, "id", ["parent_id", "name", "rank"]), rejected


def read_opentree_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """taxonomy.tsv: id, parent_id, name, rank, line_no; and the rejected lines (line_no, value)."""
    return parse_opentree_taxonomy(read_lines(spark, path))


def parse_opentree_synonyms(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    body = lines.filter(~_header(F.col("value"), "name"))
    f = body.withColumn("_f", _fields(F.col("value"), 2))
    synonym, node_id = T.strip(F.get("_f", F.lit(0))), T.parse_int(T.strip(F.get("_f", F.lit(1))))
    source = F.when(F.size("_f") >= 5, T.strip(F.get("_f", F.lit(4)))).otherwise(F.lit(""))
    ok = (F.size("_f") >= 2) & node_id.isNotNull() & (F.length(synonym) > 0)
    rows = f.filter(ok).select(
        synonym.alias("synonym"), node_id.alias("ott_id"), source.alias("source"), "line_no"
    )
    return rows, f.filter(~F.coalesce(ok, F.lit(False))).select("line_no", "value")


def read_opentree_synonyms(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """synonyms.tsv: synonym, ott_id, source, line_no; and the rejected lines. A missing file is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.globStatus(hadoop):
        none = spark.createDataFrame([], "line_no bigint, is_first boolean, value string")
        return parse_opentree_synonyms(none)
    return parse_opentree_synonyms(read_lines(spark, path))


def parse_ncbi_nodes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    f = lines.withColumn("_f", F.split("value", _BAR))
    node_id = T.parse_int(F.get("_f", F.lit(0)))
    parent = T.parse_int(F.get("_f", F.lit(1)))
    ok = (F.size("_f") >= 3) & node_id.isNotNull() & parent.isNotNull()
    rows = f.filter(ok).select(
        node_id.alias("id"),
        parent.alias("parent_id"),
        T.strip(F.get("_f", F.lit(2))).alias("rank"),
        "line_no",
    )
    rejected = f.filter(~F.coalesce(ok, F.lit(False))).select("line_no", "value")
    return _last_line_wins(rows, "id", ["parent_id", "rank"]), rejected


def read_ncbi_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes.dmp: id, parent_id, rank, line_no; and the rejected lines (line_no, value)."""
    return parse_ncbi_nodes(read_lines(spark, path))


def parse_ncbi_names(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    f = lines.withColumn("_f", F.split("value", _BAR))
    tax_id = T.parse_int(F.get("_f", F.lit(0)))
    ok = (F.size("_f") >= 4) & tax_id.isNotNull()
    rows = f.filter(ok).select(
        tax_id.alias("tax_id"),
        T.strip(F.get("_f", F.lit(1))).alias("name"),
        T.strip(F.regexp_replace(F.get("_f", F.lit(3)), r"\t?\|$", "")).alias("name_class"),
        "line_no",
    )
    return rows, f.filter(~F.coalesce(ok, F.lit(False))).select("line_no", "value")


def read_ncbi_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """names.dmp: tax_id, name, name_class, line_no, every name class; and the rejected lines."""
    return parse_ncbi_names(read_lines(spark, path))
