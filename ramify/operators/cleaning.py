"""Name cleaning, duplicate leaves, placeholder levels, common names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.functions import text as T
from ramify.operators.hierarchy import normalise_parents
from ramify.store import materialize

PLACEHOLDER = "sibling_higher"

# The attributes a node keeps.
ESSENTIAL = ["id", "parent_id", "name", "level", "x", "y", "r", "leaf_count"]


def lowercase_names(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("name", F.lower("name"))


def titlecase_names(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("name", T.titlecase("name"))


def truncate_names(nodes: DataFrame, length: int) -> DataFrame:
    return nodes.withColumn("name", T.truncate_name("name", length))


def default_names(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("name", T.default_name("name", "id"))


def keep_essential(nodes: DataFrame, columns: list[str] | None = None) -> DataFrame:
    wanted = columns or ESSENTIAL
    return nodes.select(*[c for c in wanted if c in nodes.columns])


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) by a validity condition; null counts as invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


# --- duplicate leaves -----------------------------------------------------------


def drop_duplicate_leaves(nodes: DataFrame) -> DataFrame:
    """Remove every leaf whose name (any case) occurs on more than one leaf.

    All copies go, blank names and roots are never counted, one pass only: a parent that
    loses all its children stays. Leaf rows are grouped by name carrying one
    row along, so names with many copies shrink before the shuffle and the
    survivors need no join back.
    """
    parents = normalise_parents(nodes).select(F.col("parent_id").alias("id")).filter("id is not null").distinct()
    flagged = nodes.join(parents.withColumn("_inner", F.lit(True)), "id", "left")
    below = F.coalesce(F.col("parent_id") != F.col("id"), F.lit(False))
    counted = below & F.col("_inner").isNull() & (F.length(T.strip(F.coalesce("name", F.lit("")))) > 0)
    # A row that is not counted is a group of its own.
    grouped = (
        flagged.select(
            F.when(counted, F.lower("name")).alias("_key"),
            F.when(~counted, F.col("id")).alias("_id"),
            F.struct(*nodes.columns).alias("_row"),
        )
        .groupBy("_key", "_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.any_value("_row").alias("_row"))
    )
    return grouped.filter((F.col("_n") == 1) | F.col("_key").isNull()).select("_row.*")


def duplicate_name_counts(labelled: DataFrame) -> DataFrame:
    """Copies per leaf name (any case), blank names left out."""
    return (
        labelled.filter((F.col("child_count") == 0) & (F.length(T.strip("name")) > 0))
        .groupBy(F.lower("name").alias("leaf_name"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )


# --- placeholder levels ---------------------------------------------------------


def drop_placeholder_flat(nodes: DataFrame, name: str = PLACEHOLDER) -> DataFrame:
    """One hop: children of a placeholder get its parent; placeholders go.

    The child of a placeholder below another placeholder is left with the
    removed one as its parent.
    """
    marks = nodes.filter(F.col("name") == name).select(
        F.col("id").alias("_mark"), F.col("parent_id").alias("_grand")
    )
    kept = nodes.filter(F.coalesce(F.col("name") != name, F.lit(True)))
    joined = kept.join(marks, kept["parent_id"] == marks["_mark"], "left")
    others = [c for c in nodes.columns if c != "parent_id"]
    return joined.select(
        *others, F.when(F.col("_mark").isNotNull(), F.col("_grand")).otherwise(F.col("parent_id")).alias("parent_id")
    ).select(*nodes.columns)


def drop_placeholder_deep(nodes: DataFrame, name: str = PLACEHOLDER) -> DataFrame:
    """Chains of placeholders collapse; children take the placeholder's place.

    Only the placeholder rows are resolved, by pointer doubling. The result
    has ``splice`` (name and id of the removed placeholders from the top down,
    then of the node): sorting siblings by it keeps the spliced position.
    A placeholder root stays.
    """
    rows = normalise_parents(nodes)
    marked = (F.col("name") == name) & F.col("parent_id").isNotNull()
    me = F.array(F.struct("name", "id"))
    marks = materialize(
        rows.filter(marked).select("id", F.col("parent_id").alias("up"), me.alias("chain")), "marks-0"
    )
    step = 0
    while True:
        step += 1
        above = marks.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("chain").alias("_chain"))
        hop = F.col("_id").isNotNull()
        joined = marks.join(above, marks["up"] == above["_id"], "left").select(
            "id",
            F.when(hop, F.col("_up")).otherwise(F.col("up")).alias("up"),
            F.when(hop, F.concat("_chain", "chain")).otherwise(F.col("chain")).alias("chain"),
            hop.alias("_moved"),
        ).filter(F.array_position("chain.id", F.col("id")) == F.size("chain"))
        marks, seen = materialize(joined, f"marks-{step}", {"moved": F.count_if("_moved")})
        marks = marks.drop("_moved")
        if not seen["moved"]:
            break
    kept = rows.filter(~F.coalesce(marked, F.lit(False)))
    over = marks.select(F.col("id").alias("_mark"), F.col("up").alias("_up"), F.col("chain").alias("_chain"))
    joined = kept.join(over, kept["parent_id"] == over["_mark"], "left")
    others = [c for c in nodes.columns if c != "parent_id"]
    return joined.select(
        *others,
        F.coalesce("_up", "parent_id").alias("parent_id"),
        F.coalesce(F.concat("_chain", me), me).alias("splice"),
    ).select(*nodes.columns, "splice")


# --- common names ---------------------------------------------------------------


def scientific_names(names: DataFrame) -> DataFrame:
    return names.filter(F.col("name_class") == "scientific name")


def last_scientific_name(names: DataFrame) -> DataFrame:
    """One scientific name per tax_id: the last line wins."""
    return scientific_names(names).groupBy("tax_id").agg(F.max_by("name", "line_no").alias("name"))


def best_common_name(synonyms: DataFrame) -> DataFrame:
    """Shortest common name per id; the first line wins among equals."""
    common = synonyms.filter(T.is_common_name("synonym", "source"))
    best = F.min_by("synonym", F.struct(F.length("synonym"), "line_no"))
    return common.groupBy("ott_id").agg(best.alias("common_name"))


def attach_names(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Names by id; a node without one becomes Unknown_<id>."""
    found = names.select(F.col("tax_id").alias("id"), F.col("name").alias("_name"))
    return (
        nodes.drop("name").join(found, "id", "left").withColumn("name", T.default_name("_name", "id")).drop("_name")
    )


def apply_common_names(nodes: DataFrame, common: DataFrame) -> DataFrame:
    """'Common (Scientific)' where the id has a common name."""
    named = common.select(F.col("ott_id").alias("id"), "common_name")
    return (
        nodes.join(named, "id", "left")
        .withColumn(
            "name",
            F.when(
                F.col("common_name").isNotNull(), F.concat("common_name", F.lit(" ("), "name", F.lit(")"))
            ).otherwise(F.col("name")),
        )
        .select(*nodes.columns)
    )


def common_name_coverage(nodes: DataFrame, common: DataFrame) -> DataFrame:
    """Common names, those that match a node, and nodes: (metric, value)."""
    ids = nodes.select("id").distinct()
    named = common.select(F.col("ott_id").alias("id"))
    parts = {
        "common_names": named,
        "matched": named.join(ids, "id", "left_semi"),
        "tree_nodes": ids,
    }
    return reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit(m)) for m, df in parts.items()],
    ).select("metric", "value")


def tree_ids_with_synonyms(nodes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Distinct node ids that occur among the synonym ids."""
    return nodes.select("id").intersect(synonyms.select(F.col("ott_id").alias("id")))


def count_with_common_name(nodes: DataFrame) -> DataFrame:
    """Nodes whose name has both parentheses."""
    both = F.contains("name", F.lit("(")) & F.contains("name", F.lit(")"))
    return nodes.agg(F.count_if(both).alias("with_common_name"))


# --- audit ----------------------------------------------------------------------


def cleaning_report(nodes: DataFrame, common: DataFrame | None = None, name: str = PLACEHOLDER) -> DataFrame:
    """Rows that each cleaning step changes, every step on the result of the one before: (step, changed)."""

    def total(df: DataFrame, step: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("changed")).select(F.lit(step).alias("step"), "changed")

    def fewer(before: DataFrame, after: DataFrame, step: str) -> DataFrame:
        both = before.select(F.lit(1).alias("n")).unionByName(after.select(F.lit(-1).alias("n")))
        return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("changed")).select(F.lit(step).alias("step"), "changed")

    rows = normalise_parents(nodes)
    found = []
    if common is not None:
        renamed = rows.join(common.select(F.col("ott_id").alias("id")), "id", "left_semi")
        found.append(total(renamed, "renamed"))
        rows = materialize(apply_common_names(rows, common), "report-named")
    single = materialize(drop_duplicate_leaves(rows), "report-single")
    found.append(fewer(rows, single, "duplicate leaves removed"))
    spliced = materialize(drop_placeholder_deep(single, name).drop("splice"), "report-spliced")
    found.append(fewer(single, spliced, "placeholders removed"))
    moved = spliced.join(single.select("id", F.col("parent_id").alias("_was")), "id").filter(~F.col("parent_id").eqNullSafe(F.col("_was")))
    found.append(total(moved, "re-parented"))
    found.append(total(spliced.filter(F.lower("name") != F.col("name")), "lowercased"))
    lowered = lowercase_names(spliced)
    found.append(total(lowered.filter(T.titlecase("name") != F.col("name")), "capitalised"))
    return reduce(DataFrame.unionByName, found)
