"""From taxonomy dumps to stored layout parts: the steps in their fixed order.

Duplicates go before placeholders and before lower-casing; the layout sees
lower-case names; title case comes last. The order of siblings is that of the
original names, which ``pre`` of the first labelling keeps through all steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.functions import text as T
from ramify.operators import cleaning as C
from ramify.operators import hierarchy as H
from ramify.operators.labels import label_hierarchy
from ramify.operators.layout import circle_layout, flatten_layout
from ramify.sources import parts as A
from ramify.sources import taxonomy as X
from ramify.store import materialize


def opentree_nodes(spark: SparkSession, taxonomy: str, synonyms: str | None = None, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned node table of an OpenTree dump: (id, parent_id, name, rank, ord); and the
    rejected lines (source, line_no, value)."""
    read, rejected = X.read_opentree_taxonomy(spark, taxonomy)
    rejected = rejected.withColumn("source", F.lit("taxonomy"))
    rows = materialize(read, "taxonomy")
    root = H.find_root(rows, order="line_no").first()["id"]
    tree = label_hierarchy(rows.drop("line_no"), order=_by_name(collation), root_id=root)
    nodes = tree.select("id", F.when(F.col("level") > 0, F.col("parent_id")).alias("parent_id"), "name", "rank", F.col("pre").alias("ord"))
    if synonyms is not None:
        named, lost = X.read_opentree_synonyms(spark, synonyms)
        common = C.best_common_name(named)
        rejected = _join_rejected(rejected, lost, "synonyms")
        nodes = C.apply_common_names(nodes, common)
    nodes = C.drop_duplicate_leaves(nodes)
    nodes = C.drop_placeholder_deep(nodes).drop("splice")
    return C.lowercase_names(nodes), rejected.select("source", "line_no", "value")


def _join_rejected(rejected: DataFrame, more: DataFrame, source: str) -> DataFrame:
    """Rejected lines of both; their place is kept as text, since a missing file has none."""
    place = F.col("line_no").cast("string").alias("line_no")
    return rejected.select("source", place, "value").unionByName(more.select(F.lit(source).alias("source"), place, "value"))


def ncbi_nodes(spark: SparkSession, nodes: str, names: str, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Node table of an NCBI dump: (id, parent_id, name, rank, ord); and the rejected lines
    (source, line_no, value)."""
    read, rejected = X.read_ncbi_nodes(spark, nodes)
    all_names, lost = X.read_ncbi_names(spark, names)
    rejected = _join_rejected(rejected.withColumn("source", F.lit("nodes")), lost, "names")
    rows = materialize(read, "ncbi")
    root = H.find_root(rows.withColumn("name", F.lit("")), order="line_no", fallback_id=1).first()["id"]
    named = rows.join(
        C.last_scientific_name(all_names).withColumnRenamed("tax_id", "id"), "id", "left"
    )
    name = F.when(F.col("id") == root, T.default_root_name("name")).otherwise(T.default_name("name", "id"))
    tree = label_hierarchy(
        named.select("id", "parent_id", name.alias("name"), "rank"), order=_by_name(collation), root_id=root
    )
    found = tree.select("id", F.when(F.col("level") > 0, F.col("parent_id")).alias("parent_id"), "name", "rank", F.col("pre").alias("ord"))
    return found, rejected


def _by_name(collation: str | None) -> list:
    return [F.collate(F.col("name"), collation)] if collation else []


def bake_layout(
    nodes: DataFrame,
    value: str = "leaf",
    strategy: str = "value_desc",
    size: float = 4000.0,
    padding: float = 0.0,
) -> DataFrame:
    """Stored rows (id, parent_id, name, level, x, y, r) with names in title case."""
    tree = label_hierarchy(nodes, order=[F.col("ord")])
    laid_out = circle_layout(tree.drop("ord"), value=value, strategy=strategy, size=size, padding=padding)
    return C.titlecase_names(flatten_layout(laid_out))


def write_bake(
    baked: DataFrame,
    path: str,
    parts: int = 5,
    size: float = 4000.0,
    padding: float = 0.0,
    sort_method: str | None = None,
    sort_description: str | None = None,
) -> DataFrame:
    """Write ``path/parts`` and ``path/manifest``, which lists the files as written; returns the manifest row."""
    spark = baked.sparkSession
    A.write_layout_parts(A.split_parts(baked, parts, position="id"), f"{path}/parts", position="id")
    stats = A.written_parts(spark, f"{path}/parts")
    manifest = A.build_manifest(stats, size, padding, sort_method=sort_method, sort_description=sort_description)
    A.write_manifest(manifest, f"{path}/manifest")
    return A.read_manifest(spark, f"{path}/manifest")
