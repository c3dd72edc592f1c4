"""From parent/child rows to rooted paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.operators.shared_keys import FEW_KEYS, join_shared
from ramify.store import materialize


PATH_HASH = ["path_h1", "path_h2", "path_h3"]  # 120 bits


def path_term(part: int) -> Column:
    """What a node (level, name) adds to a part of the hash of its path of names.

    The level is in it, so that the order of names counts although terms are only added,
    and hashes of two stretches of a path make up that of both. 2^22 levels fit.
    """
    return F.xxhash64(F.lit(part), "level", "name").bitwiseAND(F.lit((1 << 40) - 1))


def normalise_parents(nodes: DataFrame) -> DataFrame:
    """A node that is its own parent is a root: its parent becomes null."""
    return nodes.withColumn(
        "parent_id", F.when(F.col("parent_id") != F.col("id"), F.col("parent_id"))
    )


def link_parents(nodes: DataFrame) -> DataFrame:
    """Child to parent pairs; roots and rows with a missing parent have none."""
    child = normalise_parents(nodes).filter(F.col("parent_id").isNotNull())
    parent = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return child.select("id", "name", "parent_id").join(parent, "parent_id")


def find_root(nodes: DataFrame, order: str = "id", pick: str = "first", fallback_id: int | None = None) -> DataFrame:
    """The root row, as a one-row table (id, name).

    ``pick`` says which of several roots counts: the ``first`` or the ``last``
    in ``order``. ``fallback_id`` names the root of tables in which no row is
    its own parent. Without any root this raises.
    """
    roots = nodes.filter(F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id")))
    by = F.min_by if pick == "first" else F.max_by
    found = roots.agg(by(F.struct("id", "name"), F.col(order)).alias("r"))
    if found.first()["r"] is None:
        if fallback_id is None:
            raise ValueError("no root: every row has another row as its parent")
        return nodes.filter(F.col("id") == fallback_id).select("id", "name")
    return found.select("r.id", "r.name")


def orphans(nodes: DataFrame) -> DataFrame:
    """Rows whose parent is not in the table."""
    ids = nodes.select(F.col("id").alias("parent_id"))
    return normalise_parents(nodes).filter(F.col("parent_id").isNotNull()).join(ids, "parent_id", "left_anti")


def leaf_ids(nodes: DataFrame) -> DataFrame:
    """Ids that no other row has as its parent."""
    parents = normalise_parents(nodes).select(F.col("parent_id").alias("id")).distinct()
    return nodes.select("id").join(parents, "id", "left_anti")


def rooted(nodes: DataFrame, root_id: int | None) -> DataFrame:
    """Rows with a null parent for roots; with ``root_id`` that is the only root."""
    rows = normalise_parents(nodes)
    if root_id is None:
        return rows
    return rows.withColumn("parent_id", F.when(F.col("id") != F.lit(root_id), F.col("parent_id"))).filter(
        F.col("parent_id").isNotNull() | (F.col("id") == F.lit(root_id))
    )


def check_roots(found: int, roots: str) -> None:
    if found == 0:
        raise ValueError("no root: every row has another row as its parent")
    if roots == "one" and found > 1:
        raise ValueError(f"{found} roots; pass root_id or roots='many'")


def build_hierarchy(
    nodes: DataFrame,
    order: Sequence[Column] | None = None,
    roots: str = "one",
    root_id: int | None = None,
    max_depth: int | None = None,
    paths: bool = True,
) -> DataFrame:
    """Attach level and root-to-node path to every row that a root reaches.

    Pointer doubling: each row keeps the path segment known so far and the id
    above it; joining segments end to end doubles their length, so the number
    of joins is log2 of the depth, and every join is a plain equi-join on id.
    Rows below a missing parent or on a cycle find no root and drop out.

    ``order`` gives the sibling order (default: name); ties fall back to name
    and id. Result: input columns, ``level``, ``path`` (sort key, name and id
    from the root down), ready for a preorder sort on ``path``. Without ``paths`` it is
    input columns, ``level`` and ``root_id``, and no row grows with its depth.
    """
    rows = rooted(nodes, root_id)
    if not paths:
        levels = rooted_levels(nodes, roots, root_id, max_depth)
        return nodes.join(levels.withColumnRenamed("root_id", "_root"), "id").select(*nodes.columns, "level", F.col("_root").alias("root_id"))
    keys = [c.alias(f"k{i}") for i, c in enumerate(order or [])]
    element = F.struct(*keys, F.col("name").alias("name"), F.col("id").alias("id"))
    base = nodes.columns
    start = rows.select(*base, F.array(element).alias("path"), F.col("parent_id").alias("_up"))
    counts = {
        "open": F.count_if(F.col("_up").isNotNull()),
        "roots": F.count_if(F.col("_up").isNull()),
    }
    table, seen = materialize(start, "paths-0", counts)
    check_roots(seen["roots"], roots)

    closed = [table.filter(F.col("_up").isNull())]
    step = 0
    while seen["open"]:
        step += 1
        open_rows = table.filter(F.col("_up").isNotNull())
        above = reduce(DataFrame.unionByName, [*closed, open_rows]).select(
            F.col("id").alias("_above"), F.col("path").alias("_head"), F.col("_up").alias("_next")
        )
        # A row that meets itself above lies on a cycle. Rows below the cycle lose
        # their upper end with it and find no match in the next round.
        joined = (
            join_shared(open_rows, above.withColumnRenamed("_above", "_up"), "_up", "inner", max(1, FEW_KEYS >> step))
            .filter(~F.array_contains("_head.id", F.col("id")))
            .select(*base, F.concat("_head", "path").alias("path"), F.col("_next").alias("_up"))
        )
        if max_depth is not None:
            joined = joined.filter(F.size("path") <= max_depth + 1)
        table, seen = materialize(joined, f"paths-{step}", counts)
        closed.append(table.filter(F.col("_up").isNull()))
    done = reduce(DataFrame.unionByName, closed).drop("_up")
    done = done.withColumn("level", (F.size("path") - 1).cast("int"))
    if max_depth is not None:
        done = done.filter(F.col("level") <= max_depth)
    return done


def rooted_levels(nodes: DataFrame, roots: str = "one", root_id: int | None = None, max_depth: int | None = None) -> DataFrame:
    """(id, level, root_id) of every row that a root reaches.

    Pointer doubling on three numbers per row: the node above, the hops up to it, and
    itself once it is a root. Depths close in order, so a round that closes no row leaves
    only rows on cycles or below lost ones, which drop out.
    """
    rows = rooted(nodes, root_id).select("id", F.col("parent_id").alias("up"))
    known = rows.select(
        "id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("int").alias("hops"), F.coalesce("up", "id").alias("top")
    )
    counts = {"open": F.count_if(F.col("up").isNotNull()), "closed": F.count_if(F.col("up").isNull()), "root": F.min(F.when(F.col("up").isNull(), F.col("id")))}
    table, seen = materialize(known, "levels-0", counts)
    check_roots(seen["closed"], roots)
    # A single root is known by its id: what points at it is done.
    only = seen["root"] if seen["closed"] == 1 else None
    done = [table.filter("up is null")]
    reach = 1
    while seen["open"] and (max_depth is None or reach <= max_depth):
        rest = table.filter("up is not null")
        if only is not None:
            done.append(rest.filter(F.col("up") == F.lit(only)))
            rest = rest.filter(F.col("up") != F.lit(only))
        above = reduce(DataFrame.unionByName, [*done, rest]).select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("hops").alias("_hops"), F.col("top").alias("_top"))
        joined = join_shared(rest, above, "up", "inner").select("id", F.col("_up").alias("up"), (F.col("hops") + F.col("_hops")).cast("int").alias("hops"), F.col("_top").alias("top"))
        near = F.col("up").isNull() if only is None else F.col("up") == F.lit(only)
        table, seen = materialize(joined, f"levels-{reach}", {"open": F.count(F.lit(1)), "closed": F.count_if(near)})
        done.append(table.filter("up is null"))
        reach *= 2
        if not seen["closed"]:
            break
    if only is not None:
        done.append(table.filter(F.col("up") == F.lit(only)))
    found = reduce(DataFrame.unionByName, done).select("id", F.col("hops").alias("level"), F.col("top").alias("root_id"))
    return found if max_depth is None else found.filter(F.col("level") <= max_depth)


def unreached(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Rows that no root reaches, with the reason: missing parent or cycle."""
    lost = nodes.join(reached.select("id"), "id", "left_anti")
    missing = orphans(nodes).select("id").withColumn("reason", F.lit("missing parent"))
    return lost.join(missing, "id", "left").withColumn(
        "reason", F.coalesce("reason", F.lit("below a lost row or on a cycle"))
    )


def rehydrate(rows: DataFrame, roots: str = "one") -> tuple[DataFrame, DataFrame]:
    """Validate flat rows and link them: (linked paths, audit of metric and value).

    Raises when there is no row or no root; rows with a missing parent stay
    out of the tree and are counted in the audit.
    """
    audit = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id"))).alias("roots"),
        F.max("id").alias("max_id"),
    )
    if audit.first()["rows"] == 0:
        raise ValueError("no rows to link")
    linked = build_hierarchy(rows, roots=roots)
    report = (
        audit.select(F.explode(F.create_map(
            F.lit("rows"), F.col("rows"), F.lit("roots"), F.col("roots"), F.lit("max_id"), F.col("max_id")
        )).alias("metric", "value"))
        .unionByName(orphans(rows).agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("missing_parent")))
        .unionByName(linked.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("linked")))
    )
    return linked, report
