import random

import pytest
from pyspark.sql import functions as F

from ramify.operators import cleaning as C
from ramify.operators import hierarchy as H
from ramify.operators import labels as L
from ramify.operators.ranking import global_rank, grouped_running, top_k

NODE = "id bigint, parent_id bigint, name string"


def random_tree(n, seed, hot=0.0):
    """(id, parent, name) rows; ``hot`` is the share of nodes below node 2."""
    rng = random.Random(seed)
    rows = [(1, None, "root")]
    for i in range(2, n + 1):
        parent = 2 if i > 2 and rng.random() < hot else rng.randint(1, i - 1)
        rows.append((i, parent, f"n{rng.randint(0, n // 3)}"))
    rng.shuffle(rows)
    return rows


def walk(rows):
    """Labels by plain recursion: id -> (level, pre, pre_end, leaf_lo, leaves, size, children)."""
    kids = {}
    for i, p, name in rows:
        kids.setdefault(p, []).append((name, i))
    out, state = {}, {"pre": 0, "leaf": 0}

    def visit(i, level):
        state["pre"] += 1
        pre, leaf_lo = state["pre"], state["leaf"]
        children = sorted(kids.get(i, []))
        if not children:
            state["leaf"] += 1
        for _, c in children:
            visit(c, level + 1)
        out[i] = (level, pre, state["pre"], leaf_lo, state["leaf"] - leaf_lo, state["pre"] - pre + 1, len(children))

    for _, i in sorted(kids[None]):
        visit(i, 0)
    return out


LABELS = ["level", "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count"]


@pytest.mark.parametrize("n,seed,hot", [(1, 0, 0), (400, 1, 0), (600, 2, 0.5)])
def test_labels_match_recursion(spark, n, seed, hot):
    rows = random_tree(n, seed, hot)
    labelled = L.label_hierarchy(spark.createDataFrame(rows, NODE))
    got = {r["id"]: tuple(r[c] for c in LABELS) for r in labelled.collect()}
    assert got == walk(rows)


def test_labels_with_many_slices(spark):
    """More sorted slices than the small data would get: offsets must carry over."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = random_tree(500, 3, 0.4)
        labelled = L.label_hierarchy(spark.createDataFrame(rows, NODE))
        got = {r["id"]: tuple(r[c] for c in LABELS) for r in labelled.collect()}
        assert got == walk(rows)
        ordered = {r["id"]: r["ord"] for r in L.sibling_order(labelled).collect()}
        kids = {}
        for i, p, name in rows:
            kids.setdefault(p, []).append((name, i))
        assert ordered == {i: k for c in kids.values() for k, (_, i) in enumerate(sorted(c), 1)}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_input_order_does_not_matter(spark):
    rows = random_tree(200, 4)
    a = L.label_hierarchy(spark.createDataFrame(rows, NODE)).select("id", "pre")
    b = L.label_hierarchy(spark.createDataFrame(list(reversed(rows)), NODE)).select("id", "pre")
    assert a.exceptAll(b).count() == 0


def test_roots_orphans_and_cycles(spark, rows):
    table = [
        (1, 1, "self root"), (2, 1, "child"), (3, 99, "orphan"), (4, 3, "below orphan"),
        (5, 6, "cycle a"), (6, 5, "cycle b"), (7, 6, "below cycle"), (8, 7, "further below"),
        (9, 11, "ring"), (10, 9, "ring"), (11, 10, "ring"),
    ]
    df = spark.createDataFrame(table, NODE)
    reached = H.build_hierarchy(df)
    assert rows(reached, "id", "level") == [(1, 0), (2, 1)]
    reasons = dict(rows(H.unreached(df, reached), "id", "reason"))
    assert set(reasons) == set(range(3, 12)) and reasons[3] == "missing parent"
    assert rows(H.orphans(df), "id") == [(3,)]
    assert rows(H.link_parents(df), "id") == sorted([(2,), (4,), (5,), (6,), (7,), (8,), (9,), (10,), (11,)], key=repr)
    two = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 2, "c")], NODE)
    with pytest.raises(ValueError, match="2 roots"):
        H.build_hierarchy(two)
    assert rows(H.build_hierarchy(two, root_id=2), "id") == [(2,), (3,)]
    assert H.build_hierarchy(two, roots="many").count() == 3
    assert H.find_root(two, pick="last").first()["id"] == 2
    with pytest.raises(ValueError, match="no root"):
        H.build_hierarchy(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], NODE))
    with pytest.raises(ValueError, match="no rows"):
        H.rehydrate(spark.createDataFrame([], NODE))


def test_long_chain_and_depth_limit(spark):
    chain = spark.range(1, 301).select(
        "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent_id"), F.lit("x").alias("name")
    )
    deep = H.build_hierarchy(chain)
    assert deep.agg(F.max("level"), F.count("*")).first() == (299, 300)
    capped = L.label_hierarchy(chain, max_depth=100)
    assert capped.count() == 101
    assert capped.filter("child_count = 0").select("id").collect() == [(101,)]


def test_collation_order(spark):
    names = ["_x", "a", "A", "b", "B", "é"]
    rows = [(1, None, "r")] + [(i + 2, 1, n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, NODE)
    by_collation = L.label_hierarchy(df, order=[F.collate(F.col("name"), "UNICODE")]).filter("level = 1").orderBy("pre")
    assert [r["name"] for r in by_collation.collect()] == ["_x", "a", "A", "b", "B", "é"]
    binary = L.label_hierarchy(df).filter("level = 1").orderBy("pre")
    assert [r["name"] for r in binary.collect()] == ["A", "B", "_x", "a", "b", "é"]


def test_interval_and_path_answers_agree(spark):
    labelled = L.label_hierarchy(spark.createDataFrame(random_tree(150, 5), NODE))
    ids = labelled.select(F.col("id").alias("current_id"))
    pairs = labelled.select(F.col("id").alias("node_id"), F.explode("path_ids").alias("current_id"))
    inside = L.is_in_subtree(labelled, pairs).filter("inside").count()
    assert inside == pairs.count()
    total = L.subtree(labelled, labelled.select("id")).count()
    assert total == labelled.agg(F.sum("subtree_size")).first()[0] == pairs.count()
    none = L.is_in_subtree(labelled, ids.limit(1).select(F.col("current_id").alias("node_id"), F.lit(None).cast("bigint").alias("current_id")))
    assert none.first()["inside"] is True


def test_preset_leaf_counts(spark, rows):
    table = [(1, None, "r", 0), (2, 1, "a", 7), (3, 2, "b", 0), (4, 2, "c", 0), (5, 1, "d", 0), (6, 5, "e", 3), (7, 5, "f", 0)]
    labelled = L.label_hierarchy(spark.createDataFrame(table, NODE + ", preset int"))
    got = dict(rows(L.leaf_counts(labelled, "preset"), "id", "leaves"))
    assert got == {1: 11, 2: 7, 3: 1, 4: 1, 5: 4, 6: 3, 7: 1}


def test_ranks_on_skewed_groups(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(6)
        data = [(i, "hot" if i % 3 else f"g{i % 7}", rng.randint(0, 50)) for i in range(900)]
        df = spark.createDataFrame(data, "id int, g string, v int")
        ranked = {r["id"]: r["n"] for r in global_rank(df, ["v", "id"], "n").collect()}
        order = sorted(data, key=lambda d: (d[2], d[0]))
        assert ranked == {d[0]: i for i, d in enumerate(order, 1)}
        running = {r["id"]: (r["n"], r["s"]) for r in grouped_running(df, ["g"], ["v", "id"], "n", {"s": F.col("v")}).collect()}
        want = {}
        for g in {d[1] for d in data}:
            total = 0
            for i, d in enumerate([d for d in order if d[1] == g], 1):
                total += d[2]
                want[d[0]] = (i, total)
        assert running == want
        best = {r["id"] for r in top_k(df, ["g"], [F.col("v").desc(), "id"], 5, "n", "id").collect()}
        assert best == {d[0] for g in {d[1] for d in data} for d in sorted([d for d in data if d[1] == g], key=lambda d: (-d[2], d[0]))[:5]}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_duplicate_leaves(spark, rows):
    table = [
        (1, None, "Life"), (2, 1, "A"), (3, 1, "B"), (4, 2, "X"), (5, 3, "x"), (6, 2, " "), (7, 3, " "),
        (8, 1, "C"), (9, 8, "X"), (10, 3, "A"), (11, 2, None), (12, 2, None),
    ]
    kept = rows(C.drop_duplicate_leaves(spark.createDataFrame(table, NODE)), "id")
    # X, x, X go; C stays without children; the leaf A is no copy of the inner A.
    assert kept == sorted([(i,) for i in (1, 2, 3, 6, 7, 8, 10, 11, 12)], key=repr)


def test_placeholders(spark, rows):
    p = "sibling_higher"
    table = [(1, None, p), (2, 1, p), (3, 2, p), (4, 3, "deep"), (5, 1, "top"), (6, 2, "mid"), (7, 1, p)]
    df = spark.createDataFrame(table, NODE)
    deep = rows(C.drop_placeholder_deep(df), "id", "parent_id")
    assert deep == [(1, None), (4, 1), (5, 1), (6, 1)]
    flat = rows(C.drop_placeholder_flat(df), "id", "parent_id")
    assert flat == sorted([(4, 2), (5, None), (6, 1)], key=repr)


def test_splice_keeps_position(spark):
    table = [(1, None, "r"), (2, 1, "a"), (3, 1, "sibling_higher"), (4, 1, "z"), (5, 3, "zz"), (6, 3, "b")]
    spliced = C.drop_placeholder_deep(spark.createDataFrame(table, NODE))
    tree = L.label_hierarchy(spliced, order=[F.col("splice")])
    assert [r["name"] for r in tree.filter("level = 1").orderBy("pre").collect()] == ["a", "b", "zz", "z"]


def test_sibling_strategies(spark):
    table = [(1, None, "r", "domain"), (2, 1, "b", "genus"), (3, 1, "a", "species"), (4, 1, "c", "clade"), (5, 2, "x", ""), (6, 2, "y", ""), (7, 4, "w", "")]
    labelled = L.rollup_value(L.label_hierarchy(spark.createDataFrame(table, NODE + ", rank string")), L.node_value("leaf"))

    def order(s, **kw):
        got = L.order_siblings(labelled, s, **kw).filter("parent_id = 1").orderBy("ord")
        return "".join(r["name"] for r in got.collect())

    assert order("value_desc") == "bac" and order("value_asc") == "acb"
    assert order("name") == order("depth_asc") == order("depth_desc") == "abc"
    assert order("children_desc") == "bca" and order("rank") == "abc"
    assert order("value_then_name", collation="UNICODE") == order("hybrid") == "bac"
    assert sorted(order("random", seed=1)) == list("abc")
    assert order([F.col("name").desc(), F.col("id")]) == "cba"


@pytest.mark.parametrize("n,shape", [(200, 0.4), (120, 1.0)])
def test_labels_without_paths(spark, rows, n, shape):
    nodes = spark.createDataFrame(random_tree(n, 11, shape), "id bigint, parent_id bigint, name string")
    columns = ["id", "level", "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count"]
    whole, narrow = L.label_hierarchy(nodes), L.label_hierarchy(nodes, paths=False)
    assert rows(whole, *columns) == rows(narrow, *columns)
    assert rows(L.label_hierarchy(nodes, max_depth=2), *columns) == rows(L.label_hierarchy(nodes, max_depth=2, paths=False), *columns)


def test_levels_leave_out_cycles_and_lost_rows(spark, rows):
    nodes = [(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (5, 4, "d"), (6, 7, "x"), (7, 6, "y"), (8, 7, "z"), (9, 99, "lost"), (10, 9, "below")]
    frame = spark.createDataFrame(nodes, "id bigint, parent_id bigint, name string")
    assert rows(H.rooted_levels(frame)) == sorted([(i, i - 1, 1) for i in range(1, 6)], key=repr)
    two = spark.createDataFrame(nodes + [(20, 20, "second"), (21, 20, "s")], "id bigint, parent_id bigint, name string")
    assert rows(H.rooted_levels(two, roots="many").filter("root_id = 20"), "id", "level") == [(20, 0), (21, 1)]
    with pytest.raises(ValueError):
        H.rooted_levels(two)
    chain = spark.createDataFrame([(i, i - 1 if i > 1 else None, "n") for i in range(1, 2001)], "id bigint, parent_id bigint, name string")
    deep = L.label_hierarchy(chain, paths=False)
    assert deep.filter("level <> id - 1 or pre <> id or pre_end <> 2000 or subtree_size <> 2001 - id or leaf_count <> 1").count() == 0
