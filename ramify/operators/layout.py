"""Nested circle layout of a labelled table.

Bottom-up, one round per level: the radii of a level's families follow from the number
and radius of their size classes. Then all circles are placed at once inside their
parents, by closed forms of their number in their class, and every node's offset to its
parent is summed along its path by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.functions.geometry import round_half_up
from ramify.functions.packing import place, size_class, stack_classes
from ramify.operators.enclosing import enclosing_circles
from ramify.operators.hierarchy import build_hierarchy
from ramify.operators.labels import label_hierarchy, node_value, order_siblings, rollup_value
from ramify.operators.ranking import global_rank, grouped_running
from ramify.operators.shared_keys import join_shared
from ramify.store import materialize, transient


def _families(circles: DataFrame) -> DataFrame:
    """(family, whole, placed) of circles(family, r): see ``stack_classes``.

    Families are counted by class first, so that one of any size is a few rows.
    """
    counted = (
        circles.groupBy("family", size_class(F.col("r")).alias("class"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("q"))
    )
    by_size = F.reverse(F.array_sort(F.collect_list(F.struct("class", "n", "q"))))
    return counted.groupBy("family").agg(stack_classes(by_size).alias("_s")).select("family", "_s.whole", "_s.placed")


def pack_families(circles: DataFrame) -> DataFrame:
    """Offsets of packed children: ``circles(family, id, ord, r)`` ->
    (family, id, dx, dy, whole), ``whole`` being the radius around the family.
    """
    families = materialize(_families(circles), "families")
    return _place(circles, families).select("family", "id", "dx", "dy", "whole")


def _place(circles: DataFrame, families: DataFrame) -> DataFrame:
    numbered = grouped_running(circles.withColumn("class", size_class(F.col("r"))), ["family", "class"], ["ord"], "_m")
    joined = numbered.join(families, "family").withColumn(
        "_c", F.element_at(F.filter("placed", lambda c: c["class"] == F.col("class")), 1)
    )
    dx, dy = place(F.col("_m") - 1, F.col("_c"))
    return joined.withColumn("dx", dx).withColumn("dy", dy)


def _pack_levels(tree: DataFrame, depth: int, pad: float) -> tuple[DataFrame, float]:
    """(offsets, radius of the root): offsets(id, parent_id, dx, dy, r) for all nodes."""
    own = F.sqrt(F.col("value").cast("double"))
    sized, families, above = [], [], None
    for level in range(depth, -1, -1):
        nodes = tree.filter(F.col("level") == level).select("id", "parent_id", "ord", own.alias("r"))
        if above is not None:
            whole = above.select(F.col("family").alias("id"), (F.col("whole") + pad).alias("_whole"))
            nodes = nodes.join(whole, "id", "left").withColumn("r", F.coalesce("_whole", "r")).drop("_whole")
        nodes = materialize(nodes, f"sized-{level}")
        sized.append(nodes)
        if level:
            above = materialize(_families(nodes.select(F.col("parent_id").alias("family"), (F.col("r") + pad).alias("r"))), f"families-{level}")
            families.append(above)
    root = sized.pop()
    radius = root.agg(F.max("r")).first()[0]
    offsets = root.select("id", F.lit(None).cast("bigint").alias("parent_id"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "r")
    if sized:
        below = reduce(DataFrame.unionByName, sized).select(F.col("parent_id").alias("family"), "id", "ord", (F.col("r") + pad).alias("r"))
        placed = _place(below, reduce(DataFrame.unionByName, families))
        offsets = offsets.unionByName(placed.select("id", F.col("family").alias("parent_id"), "dx", "dy", (F.col("r") - pad).alias("r")))
    return materialize(offsets, "offsets"), radius


def _pack_levels_tightly(tree: DataFrame, depth: int, pad: float) -> tuple[DataFrame, float]:
    """As ``_pack_levels``; a parent is the smallest circle around its children, and they are moved to its centre."""
    own = F.sqrt(F.col("value").cast("double"))
    packed, above = [], None
    for level in range(depth, -1, -1):
        nodes = tree.filter(F.col("level") == level).select("id", "parent_id", "ord", own.alias("r"))
        if above is not None:
            whole = above.select(F.col("family").alias("id"), (F.col("radius") + pad).alias("_whole"))
            nodes = nodes.join(whole, "id", "left").withColumn("r", F.coalesce("_whole", "r")).drop("_whole")
        if not level:
            break
        circles = materialize(nodes.select(F.col("parent_id").alias("family"), "id", "ord", (F.col("r") + pad).alias("r")), f"sized-{level}")
        placed = materialize(_place(circles, materialize(_families(circles), f"families-{level}")).select("family", "id", "dx", "dy", "r"), f"placed-{level}")
        above = materialize(enclosing_circles(placed.select("family", F.col("dx").alias("x"), F.col("dy").alias("y"), "r")), f"around-{level}")
        packed.append(
            placed.join(above, "family").select(
                "id", F.col("family").alias("parent_id"), (F.col("dx") - F.col("cx")).alias("dx"), (F.col("dy") - F.col("cy")).alias("dy"), (F.col("r") - pad).alias("r")
            )
        )
    root = materialize(nodes, "sized-0")
    radius = root.agg(F.max("r")).first()[0]
    offsets = root.select("id", F.lit(None).cast("bigint").alias("parent_id"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "r")
    return materialize(reduce(DataFrame.unionByName, packed, offsets), "offsets"), radius


def _sum_offsets(offsets: DataFrame) -> DataFrame:
    """Offsets summed from the root down: (id, x, y, r)."""
    open_rows = offsets.select("id", F.col("parent_id").alias("up"), "dx", "dy", "r")
    closed = [open_rows.filter("up is null")]
    table = open_rows
    step = 0
    while True:
        above = closed[0]
        for c in closed[1:]:
            above = above.unionByName(c)
        active = table.filter("up is not null")
        above = above.unionByName(active).select(
            F.col("id").alias("up"), F.col("up").alias("_up"), F.col("dx").alias("_dx"), F.col("dy").alias("_dy")
        )
        joined = join_shared(active, above, "up", "inner").select(
            "id", F.col("_up").alias("up"), (F.col("dx") + F.col("_dx")).alias("dx"), (F.col("dy") + F.col("_dy")).alias("dy"), "r"
        )
        table, seen = materialize(joined, f"sums-{step}", {"open": F.count_if(F.col("up").isNotNull())})
        closed.append(table.filter("up is null"))
        step += 1
        if not seen["open"]:
            break
    whole = closed[0]
    for c in closed[1:]:
        whole = whole.unionByName(c)
    return whole.select("id", F.col("dx").alias("x"), F.col("dy").alias("y"), "r")


def circle_layout(
    labelled: DataFrame,
    value: str | Column = "leaf",
    strategy: str | Sequence[Column] = "value_desc",
    size: float = 4000.0,
    padding: float = 0.0,
    tight: bool = False,
) -> DataFrame:
    """Labelled rows plus ``value, ord, x, y, r``; the root is centred at (0, 0).

    Leaf radius is the root of the rolled-up value; siblings stand in rings
    by size and sibling order; a parent is the circle around its children; the whole is
    scaled to a root radius of size / 2. ``value`` is a preset or a Column,
    ``strategy`` a preset or sort keys forming a total order. With ``tight`` a parent is
    the smallest circle around its children instead of their outermost ring, for some
    more jobs per level.
    """
    with transient(labelled.sparkSession):
        ready = {"leaf": "leaf_count", "node": "subtree_size"}.get(value) if isinstance(value, str) else None
        if ready:
            # Leaves or nodes below: the roll-up is a label already.
            valued = labelled.withColumn("value", F.col(ready))
        else:
            valued = rollup_value(labelled, node_value(value) if isinstance(value, str) else value)
        narrow = valued.drop("path_ids", "path_names")
        parent = F.when(F.col("level") > 0, F.col("parent_id")).alias("parent_id")
        # Sorted by level, so that a round reads the row groups of its level.
        tree = materialize(
            order_siblings(narrow, strategy)
            .select("id", parent, "level", "ord", "value")
            .repartitionByRange("level", "id")
            .sortWithinPartitions("level", "id"),
            "ordered",
        )
        depth = tree.agg(F.max("level")).first()[0]
        pack = _pack_levels_tightly if tight else _pack_levels
        offsets, radius = pack(tree, depth, 0.0)
        if padding:
            offsets, radius = pack(tree, depth, padding * radius / size)
        scale = size / 2 / radius
        placed = _sum_offsets(offsets).select("id", *[(F.col(c) * scale).alias(c) for c in ("x", "y", "r")])
        places = placed.join(tree.select("id", "ord", "value"), "id")
        return materialize(labelled.join(places, "id"), "laid-out", keep=True)


def flatten_layout(laid_out: DataFrame) -> DataFrame:
    """Rows as they are stored: ids in level order, coordinates with two decimals.

    The level order follows the sibling order ``ord`` of the layout.
    """
    rows = laid_out.select(
        "id", F.when(F.col("level") > 0, F.col("parent_id")).alias("parent_id"), "name", "ord", "x", "y", "r"
    )
    rows = materialize(rows, "layout-rows")
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        # Preorder inside a level is the order of the paths, and is one number.
        tree = label_hierarchy(rows, order=[F.col("ord")], roots="many", paths=False)
        ranked = global_rank(tree.select(*rows.columns, "level", "pre"), ["level", "pre"], "bfs")
    else:
        ranked = global_rank(build_hierarchy(rows, order=[F.col("ord")], roots="many"), ["level", "path"], "bfs")
    parents = ranked.select(F.col("id").alias("parent_id"), F.col("bfs").alias("bfs_parent"))
    return join_shared(ranked, parents, "parent_id").select(
        F.col("bfs").alias("id"),
        F.col("bfs_parent").alias("parent_id"),
        "name",
        "level",
        round_half_up(F.col("x")).alias("x"),
        round_half_up(F.col("y")).alias("y"),
        round_half_up(F.col("r")).alias("r"),
    )
