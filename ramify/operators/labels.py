"""The labelled node table, and the questions it answers without recursion.

Labels are computed once. After that "a is an ancestor of d" is a comparison of
preorder numbers, a leaf count is a column and a path is a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramify.operators.hierarchy import PATH_HASH, check_roots, normalise_parents, path_term, rooted, rooted_levels
from ramify.operators.ranking import global_rank, grouped_running, slice_offsets, sorted_slices
from ramify.operators.shared_keys import FEW_KEYS, join_shared
from ramify.store import materialize, transient


_RANGE_BLOCK = 64  # preorder numbers per block of a range join


def label_hierarchy(
    nodes: DataFrame,
    order: Sequence[Column] | None = None,
    roots: str = "one",
    root_id: int | None = None,
    max_depth: int | None = None,
    paths: bool = True,
) -> DataFrame:
    """Labelled node table.

    Adds ``level, path_ids, path_names, pre, pre_end, leaf_lo, leaf_count, subtree_size,
    child_count`` and the hash of the path of names (PATH_HASH). ``pre`` numbers nodes in
    preorder from 1 and a subtree is ``[pre, pre_end]``; leaves are numbered from 0 in the
    same order and those of a subtree are ``[leaf_lo, leaf_lo + leaf_count)``. Rows that
    no root reaches drop out.

    The table is written sorted by ``pre``: range filters on it prune row groups.
    Without ``paths`` it lacks path_ids and path_names, and the work is that of a few
    numbers per node and doubling round, however deep the tree.

    Inside a family each node starts after its earlier siblings, and starts add up along
    the way to the root, in rounds that double the distance; so do path hashes, and paths
    grow in the same rounds.
    """
    with transient(nodes.sparkSession):
        rows = rooted(nodes, root_id)
        if max_depth is not None:
            rows = rows.join(rooted_levels(nodes, roots, root_id, max_depth).select("id"), "id", "left_semi")
        keys = [c.alias(f"_k{i}") for i, c in enumerate(order or [])]
        sized, unique = _sized(rows.select("id", "parent_id", "name", *keys), roots)
        placed = grouped_running(
            sized, ["parent_id"], [*[f"_k{i}" for i in range(len(keys))], "name", "id"], "_ord",
            {"_before": F.col("size"), "_leaves_before": F.col("leaves")},
        )
        placed = materialize(placed.drop("_ord", *[f"_k{i}" for i in range(len(keys))]), "placed")
        summed = {"pre": F.col("_before") - F.col("size") + 1, "leaf_lo": F.col("_leaves_before") - F.col("leaves")}
        hashed = {c: path_term(i) for i, c in enumerate(PATH_HASH)}
        summed |= hashed
        joined = {"path_ids": F.array("id"), "path_names": F.array("name")} if paths else {}
        both = summed | joined

        def below(steps: DataFrame, upper: DataFrame, *kept: str) -> DataFrame:
            """``steps`` continued by those of ``upper``, the rows that ``up`` points at."""
            above = upper.select(F.col("id").alias("up"), F.col("up").alias("_up"), *[F.col(c).alias(f"_{c}") for c in both])
            longer = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in summed]
            longer += [F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.concat(f"_{c}", c)).alias(c) for c in joined]
            return join_shared(steps, above, "up", few=max(1, FEW_KEYS // reach)).select("id", *kept, F.col("_up").alias("up"), *longer)

        # Only nodes with children are pointed at: leaves wait for their parent's sums and join once.
        spine = placed.filter(_SPINE)
        is_open = {"open": F.count_if(F.col("up").isNotNull())}
        reach = 1
        starts, seen = materialize(spine.select("id", F.col("parent_id").alias("up"), *[c.alias(n) for n, c in both.items()]), "starts", is_open)
        while seen["open"]:
            starts, seen = materialize(below(starts, starts), "starts", is_open)
            reach *= 2
        own = ["parent_id", "name", "child_count", "size", "leaves", "level"]
        hanging = placed.filter(f"not ({_SPINE})").withColumn("up", F.col("parent_id"))
        if unique:
            # The level of a leaf is that of its parent and one; leaves below lost rows find none.
            levels = spine.select("id", F.col("level").alias("_level"))
            upper = starts.join(levels, "id")
            above = upper.select(F.col("id").alias("up"), "_level", *[F.col(c).alias(f"_{c}") for c in both])
            # The level is in the hash, so a leaf's own term comes after the join.
            longer = [(hashed.get(c, F.col(c)) + F.col(f"_{c}")).alias(c) for c in summed] + [F.concat(f"_{c}", c).alias(c) for c in joined]
            leaves = join_shared(
                hanging.select("id", "up", "parent_id", "name", "child_count", "size", "leaves", *[c.alias(n) for n, c in both.items() if n not in hashed]),
                above, "up", "inner", max(1, FEW_KEYS // reach),
            ).withColumn("level", F.col("_level") + 1).select("id", *own, *longer)
            labels = leaves.unionByName(starts.drop("up").join(spine.select("id", *own), "id"))
        else:
            ends = below(hanging.select("id", "up", *[c.alias(n) for n, c in both.items()]), starts)
            labels = placed.select("id", "child_count", "size", "leaves", "level").join(starts.unionByName(ends).drop("up"), "id")
        labels = labels.withColumn("pre_end", F.col("pre") + F.col("size") - 1).withColumnsRenamed({"size": "subtree_size", "leaves": "leaf_count"})
        if unique and set(nodes.columns) == {"id", "parent_id", "name"}:
            labelled = labels
        else:
            labelled = rows.join(labels.drop("parent_id", "name"), "id")
        labelled = labelled.select(
            *nodes.columns, "level", *joined, "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count", *PATH_HASH
        )
        return materialize(labelled.repartitionByRange("pre").sortWithinPartitions("pre"), "labelled", keep=True)


# Roots, and rows that others point at.
_SPINE = "child_count > 0 or parent_id is null"


def _sized(rows: DataFrame, roots: str) -> tuple[DataFrame, bool]:
    """``rows`` that a root reaches, with level, child_count, size and leaves of their subtrees;
    and whether no id repeats.

    Leaves are counted at their parents, and only rows with children take part in the
    rounds. After k rounds such a row has the sum over its descendants less than 2^k levels
    below, and knows its ancestor 2^k levels up; the next round adds its sum to that
    ancestor's. A round in which no row comes to its end leaves only cycles and what hangs
    on them. With unique ids, leaves come without a level and also below lost rows: who
    joins them to their parents knows both.
    """
    kids = rows.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("child_count"))
    same = Window.partitionBy("id")
    counted = rows.join(kids, "id", "left").na.fill(0, ["child_count"]).withColumn("_copies", F.when(F.col("id").isNotNull(), F.count(F.lit(1)).over(same)))
    tree, seen = materialize(counted, "tree", {"copies": F.max("_copies")})
    unique = (seen["copies"] or 0) <= 1
    tree = tree.drop("_copies")
    one = F.lit(1).cast("bigint")
    spine, hanging = tree.filter(_SPINE), tree.filter(f"not ({_SPINE})")
    hung = hanging.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("_hung"))
    counts = {"open": F.count_if(F.col("up").isNotNull()), "ended": F.count_if(F.col("up").isNull())}
    sums, seen = materialize(
        spine.join(hung, "id", "left").select(
            "id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("level"),
            (one + F.coalesce("_hung", F.lit(0))).alias("size"),
            ((F.col("child_count") == 0).cast("bigint") + F.coalesce("_hung", F.lit(0))).alias("leaves"), F.lit(False).alias("lost"),
        ),
        "sums", counts,
    )
    check_roots(seen["ended"], roots)
    ended = None
    while seen["open"] and seen["ended"] != ended:
        ended = seen["ended"]
        below = sums.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("_size"), F.sum("leaves").alias("_leaves"))
        above = sums.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"), F.col("lost").alias("_lost"))
        # Without a row above, a row that points upward is lost, and all below it.
        lost = F.col("lost") | F.coalesce("_lost", F.col("up").isNotNull())
        grown = materialize(
            sums.join(below, "id", "left").select(
                "id", "up", "level", "lost", (F.col("size") + F.coalesce("_size", F.lit(0))).alias("size"),
                (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
            ),
            "sums-grown",
        )
        sums, seen = materialize(
            join_shared(grown, above, "up").select(
                "id", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level"), "size", "leaves", lost.alias("lost")
            ),
            "sums", counts,
        )
    reached = sums.filter("up is null and not lost").drop("up", "lost")
    if unique:
        alone = hanging.select("*", F.lit(None).cast("int").alias("level"), one.alias("size"), one.alias("leaves"))
        return spine.join(reached, "id").unionByName(alone), True
    # Ids that repeat meet each other, as in any join on them.
    level = reached.select(F.col("id").alias("parent_id"), (F.col("level") + 1).alias("level"))
    ends = join_shared(hanging.select("id", "parent_id"), level, "parent_id", "inner").select("id", "level", one.alias("size"), one.alias("leaves"))
    return tree.join(reached.unionByName(ends), "id"), False


# --- orders -----------------------------------------------------------------


def sibling_order(labelled: DataFrame, order: Sequence[Column | str] = ("pre",)) -> DataFrame:
    """``ord``: position of each node among its siblings (1-based)."""
    return grouped_running(labelled, ["parent_id"], list(order), "ord")


def bfs_ids(labelled: DataFrame) -> DataFrame:
    """Ids renumbered from 1 in level order, with the parent's new id.

    Preorder restricted to one level is the sibling order of that level.
    """
    ranked = global_rank(labelled, ["level", "pre"], "bfs")
    parents = ranked.select(F.col("id").alias("parent_id"), F.col("bfs").alias("bfs_parent"))
    return ranked.join(parents, "parent_id", "left")


def dfs_ids(labelled: DataFrame, first_id: int = 1, start_level: int = 0) -> DataFrame:
    """Preorder ids from ``first_id``; levels counted from ``start_level``."""
    return labelled.withColumn("dfs", F.col("pre") + F.lit(first_id - 1)).withColumn(
        "level", F.col("level") + F.lit(start_level)
    )


def pick_order(labelled: DataFrame) -> DataFrame:
    """``pick_rank``: deepest nodes first, ties in preorder."""
    return global_rank(labelled, [F.col("level").desc(), "pre"], "pick_rank")


# --- paths and subtrees -------------------------------------------------------


def node_path(labelled: DataFrame, separator: str = "/") -> DataFrame:
    """``path``: names from the root down, joined by ``separator``."""
    return labelled.withColumn("path", F.array_join("path_names", separator))


def subtree(labelled: DataFrame, requests: DataFrame) -> DataFrame:
    """Descendants-or-self of every requested id: (root_id, node columns).

    A subtree is a range of preorder numbers. Numbers are cut into blocks, and a range
    meets its nodes in an equi-join on the block: as many rows as the result has, and at
    most two blocks per request besides. Order by (root_id, pre) for preorder.
    """
    wanted = requests.select(F.col("id").alias("root_id")).distinct()
    ends = labelled.select(F.col("id").alias("root_id"), F.col("pre").alias("_lo"), F.col("pre_end").alias("_hi"))
    blocks = F.sequence(F.floor(F.col("_lo") / _RANGE_BLOCK), F.floor(F.col("_hi") / _RANGE_BLOCK))
    ranges = wanted.join(ends, "root_id").withColumn("_block", F.explode(blocks))
    return (
        labelled.withColumn("_block", F.floor(F.col("pre") / _RANGE_BLOCK))
        .join(ranges, "_block")
        .filter(F.col("pre").between(F.col("_lo"), F.col("_hi")))
        .drop("_block", "_lo", "_hi")
    )


def subtree_of(labelled: DataFrame, node_id: int) -> DataFrame:
    """Subtree of one node as a preorder range, so that the scan can prune."""
    bounds = labelled.filter(F.col("id") == node_id).select("pre", "pre_end").first()
    if bounds is None:
        return labelled.limit(0)
    return labelled.filter(F.col("pre").between(bounds["pre"], bounds["pre_end"]))


def go_up(labelled: DataFrame, requests: DataFrame) -> DataFrame:
    """Parent row of every requested id; a root has none."""
    asked = requests.select(F.col("id").alias("from_id"))
    child = labelled.select(F.col("id").alias("from_id"), F.col("parent_id").alias("id"))
    return asked.join(child, "from_id").join(labelled, "id")


def focus(labelled: DataFrame, requests: DataFrame) -> DataFrame:
    """Size of what is visible with each requested node in focus, and the way up."""
    return requests.select("id").join(labelled, "id").select(
        "id", "name", "parent_id", "subtree_size", "leaf_count"
    )


def is_in_subtree(labelled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node_id, current_id) pairs with ``inside``: self or descendant.

    A pair without a current node is inside.
    """
    # Pairs without a current node need no lookup, and would all meet under one key.
    asked, free = pairs.filter("current_id is not null"), pairs.filter("current_id is null")
    node = labelled.select(F.col("id").alias("node_id"), F.col("pre").alias("_pre"))
    current = labelled.select(
        F.col("id").alias("current_id"), F.col("pre").alias("_lo"), F.col("pre_end").alias("_hi")
    )
    looked_up = (
        asked.join(node, "node_id", "left")
        .join(current, "current_id", "left")
        .withColumn("inside", F.coalesce(F.col("_pre").between(F.col("_lo"), F.col("_hi")), F.lit(False)))
        .drop("_pre", "_lo", "_hi")
    )
    return looked_up.unionByName(free.withColumn("inside", F.lit(True)))


# --- aggregates ---------------------------------------------------------------


def leaf_counts(labelled: DataFrame, preset: str | None = None) -> DataFrame:
    """``leaves``: 1 for a leaf, the sum of the children above.

    With ``preset`` a non-zero value of that column stands for the node, and
    its ancestors add that value instead of what lies below it.

    What lies below a preset node, down to the next ones, is taken off again there, so
    that a roll-up over preorder numbers gives the sums. No path is needed.
    """
    if preset is None:
        return labelled.withColumn("leaves", F.col("leaf_count"))
    given = F.nullif(F.col(preset), F.lit(0)).cast("bigint")
    value = F.coalesce(given, (F.col("child_count") == 0).cast("bigint"))
    below = _below_marked(labelled, given.isNotNull(), value)
    sums = rollup_values(
        labelled.select("id", "pre", "pre_end", value.alias("_value")).join(below, "id", "left"),
        {"_leaves": F.col("_value") - F.coalesce("_below", F.lit(0))},
    )
    return labelled.join(sums, "id").withColumn("leaves", F.coalesce(given, "_leaves")).drop("_leaves")


def _below_marked(labelled: DataFrame, marked: Column, value: Column) -> DataFrame:
    """(id, _below): per marked node, ``value`` of the nodes below it that no other marked node parts from it.

    How many marked nodes lie above a node is the number of their ranges that have begun
    before it, less those that have ended. Of the ranges of one such depth, the last to
    begin is the one that a node stands in: a count inside the depth names it.
    """
    rows = materialize(labelled.select("id", "pre", "pre_end", marked.alias("_marked"), value.alias("_value")), "cover-rows")
    ended = rows.filter("_marked").groupBy((F.col("pre_end") + 1).alias("pre")).agg(F.count(F.lit(1)).alias("_ended"))
    begun = F.col("_marked").cast("bigint")
    change = begun - F.coalesce("_ended", F.lit(0))
    slices = sorted_slices(rows.join(ended, "pre", "left"), ["pre"], "cover")
    offsets = slice_offsets(slices, {"_before": F.sum(change)})
    upto = Window.partitionBy("_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    covered = slices.join(F.broadcast(offsets), "_slice").withColumn("_depth", F.col("_before") + F.sum(change).over(upto) - begun)
    stands = covered.filter("_depth > 0").select("id", "pre", "_depth", F.lit(0).alias("_begins"), "_value")
    begins = covered.filter("_marked").select("id", "pre", (F.col("_depth") + 1).alias("_depth"), F.lit(1).alias("_begins"), F.lit(0).cast("bigint").alias("_value"))
    named = materialize(grouped_running(stands.unionByName(begins), ["_depth"], ["pre", "_begins"], "_nr", {"_range": F.col("_begins")}), "cover-ranges")
    sums = named.filter("_begins = 0").groupBy("_depth", "_range").agg(F.sum("_value").alias("_below"))
    return named.filter("_begins = 1").join(sums, ["_depth", "_range"]).select("id", "_below")


def rollup_values(labelled: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(id, values): each ``value`` of the node + those of all nodes below it.

    A subtree is a range of preorder numbers, so a sum is the difference of two running
    sums: one pass for all values, and two equi-joins on the number.
    """
    slices = sorted_slices(labelled.select("pre", *[c.alias(n) for n, c in values.items()]), ["pre"], "rollup")
    offsets = slice_offsets(slices, {f"_o_{n}": F.sum(n) for n in values})
    inside = Window.partitionBy("_slice").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    running = slices.join(F.broadcast(offsets), "_slice").select(
        "pre", *[(F.sum(n).over(inside) + F.col(f"_o_{n}")).alias(f"_s_{n}") for n in values]
    )
    running = materialize(running, "rollup-sums")
    upto = running.withColumnRenamed("pre", "pre_end")
    before = running.select((F.col("pre") + 1).alias("pre"), *[F.col(f"_s_{n}").alias(f"_b_{n}") for n in values])
    return (
        labelled.select("id", "pre", "pre_end")
        .join(upto, "pre_end")
        .join(before, "pre", "left")
        .select("id", *[(F.col(f"_s_{n}") - F.coalesce(F.col(f"_b_{n}"), F.lit(0))).alias(n) for n in values])
    )


def rollup_value(labelled: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Node value = ``value`` of the node + the values of its children."""
    return labelled.join(rollup_values(labelled, {name: value}), "id")


def family_stats(nodes: DataFrame) -> DataFrame:
    """Number of direct children per parent."""
    return (
        normalise_parents(nodes)
        .filter(F.col("parent_id").isNotNull())
        .groupBy("parent_id")
        .agg(F.count(F.lit(1)).alias("child_count"))
    )


def family_leaf_offsets(labelled: DataFrame) -> DataFrame:
    """``leaves_upto``: leaves under a node and the siblings before it.

    Leaves are numbered in preorder, so inside a family this is a difference
    of two labels.
    """
    parents = labelled.select(F.col("id").alias("parent_id"), F.col("leaf_lo").alias("_first"))
    return (
        labelled.join(parents, "parent_id")
        .withColumn("leaves_upto", F.col("leaf_lo") + F.col("leaf_count") - F.col("_first"))
        .drop("_first")
    )


def random_leaf(labelled: DataFrame, requests: DataFrame) -> DataFrame:
    """Leaf number floor(u * leaf_count) of each requested (id, u), u in [0, 1)."""
    chosen = requests.join(labelled.select("id", "leaf_lo", "leaf_count"), "id").withColumn(
        "_leaf", F.col("leaf_lo") + F.floor(F.col("u") * F.col("leaf_count"))
    )
    leaves = labelled.filter(F.col("child_count") == 0).select(
        F.col("leaf_lo").alias("_leaf"), F.col("id").alias("leaf_id"), F.col("name").alias("leaf_name")
    )
    return chosen.join(leaves, "_leaf").drop("_leaf", "leaf_lo", "leaf_count")


# --- sibling orders and node values -------------------------------------------

# Priority of taxonomic ranks; any other rank counts 99.
RANK_PRIORITY = {
    "species": 1,
    "genus": 2,
    "family": 3,
    "order": 4,
    "class": 5,
    "phylum": 6,
    "kingdom": 7,
    "domain": 8,
}


def sibling_strategy(name: str, seed: int = 0, collation: str | None = None) -> list[Column]:
    """Sort keys of a named sibling order, for ``order_siblings``.

    Expects the columns of the labelled table and, for the value orders, ``value``.
    """
    by_name = F.collate(F.col("name"), collation) if collation else F.col("name")
    rank = F.create_map(*[F.lit(x) for kv in RANK_PRIORITY.items() for x in kv])
    keys: dict[str, list] = {
        "value_desc": [F.col("value").desc(), F.col("pre")],
        "value_asc": [F.col("value").asc(), F.col("pre")],
        "name": [by_name],
        "depth_asc": [F.col("level").asc(), F.col("pre")],
        "depth_desc": [F.col("level").desc(), F.col("pre")],
        "leaves_desc": [F.col("leaf_count").desc(), F.col("pre")],
        "children_desc": [F.col("child_count").desc(), F.col("pre")],
        "value_then_name": [F.col("value").desc(), by_name],
        "random": [F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))))],
        "hybrid": [F.col("value").desc(), F.col("level").asc(), F.col("pre")],
    }
    if name == "rank":
        return [F.coalesce(F.try_element_at(rank, F.col("rank")), F.lit(99)), F.col("pre"), F.col("id")]
    return [*keys[name], F.col("id")]


def order_siblings(labelled: DataFrame, strategy: str | Sequence[Column], **options) -> DataFrame:
    """``ord`` in a named order or in the caller's own sort keys (total order)."""
    keys = sibling_strategy(strategy, **options) if isinstance(strategy, str) else list(strategy)
    return grouped_running(labelled, ["parent_id"], keys, "ord")


def node_value(name: str) -> Column:
    """Value of one node before the roll-up."""
    leaf = F.col("child_count") == 0
    return {
        "leaf": F.when(leaf, 1).otherwise(0).cast("bigint"),
        "node": F.lit(1).cast("bigint"),
        "leaf_count": F.col("leaf_count"),
        "depth_weighted": F.when(leaf, F.pow(F.lit(0.9), F.col("level"))).otherwise(0.0),
    }[name]
