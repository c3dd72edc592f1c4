"""Keys that very many rows share, and what takes part in the rounds of a labelling."""

import pytest
from pyspark.sql import functions as F

from ramify.operators import hierarchy as H
from ramify.operators import labels as L
from ramify.operators import layout as Y
from ramify.operators import shared_keys as K
from ramify.sources import parts as A

# Root 1, inner 2..4, leaves 100 and up; 900 hangs on a missing parent, 910 and 911 on a cycle.
NODES = [(1, None, "r"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d")]
NODES += [(100 + i, 2 + i % 3, f"n{i % 7}") for i in range(30)]
LOST = [(900, 899, "x"), (901, 900, "x"), (910, 911, "x"), (911, 910, "x"), (912, 911, "x")]
SCHEMA = "id bigint, parent_id bigint, name string"


def walked(nodes, roots):
    """id -> (level, pre, pre_end, leaf_lo, leaf_count, child_count, names) by a plain walk."""
    kids = {}
    for i, up, name in nodes:
        kids.setdefault(up, []).append((name, i))
    found, counts = {}, [0, 0]

    def visit(i, level, names):
        counts[0] += 1
        pre, lo = counts[0], counts[1]
        below = sorted(kids.get(i, []))
        for name, k in below:
            visit(k, level + 1, [*names, name])
        counts[1] += not below
        found[i] = (level, pre, counts[0], lo, counts[1] - lo, len(below), names)

    for name, i in sorted(kids[None]):
        visit(i, 0, [name])
    return found


@pytest.mark.parametrize(("few", "shared"), [(50_000, 100_000), (0, 5), (0, 100_000)])
def test_join_shared_gives_what_a_join_gives(spark, rows, monkeypatch, few, shared):
    monkeypatch.setattr(K, "SHARED_BY", shared)
    left = spark.createDataFrame([(i, [7, 8, None, 9, i][i % 5]) for i in range(60)], "id int, k int")
    right = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (14, "d"), (99, "e")], "k int, v string")
    for how in ("left", "inner"):
        assert rows(K.join_shared(left, right, "k", how, few), "id", "k", "v") == rows(left.join(right, "k", how), "id", "k", "v")


def test_rows_of_one_key_stay_out_of_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARED_BY", 5)
    left = spark.createDataFrame([(i, 7 if i % 2 else i) for i in range(60)], "id int, k int")
    right = spark.createDataFrame([(i, i) for i in range(60)], "k int, v int")
    plan = K.join_shared(left, right, "k", "inner", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan  # the shared key is taken out, and joined apart


@pytest.mark.parametrize("few", [50_000, 0])
def test_labels_with_lost_rows(spark, monkeypatch, few):
    monkeypatch.setattr(L, "FEW_KEYS", few)
    monkeypatch.setattr(K, "SHARED_BY", 5)
    got = L.label_hierarchy(spark.createDataFrame(NODES + LOST, SCHEMA))
    columns = ["id", "level", "pre", "pre_end", "leaf_lo", "leaf_count", "child_count", "path_names"]
    assert {r[0]: tuple(r[1:]) for r in got.select(columns).collect()} == walked(NODES, 1)
    narrow = L.label_hierarchy(spark.createDataFrame(NODES + LOST, SCHEMA).withColumn("more", F.col("id") * 2), paths=False)
    assert {r.id: (r.level, r.pre, r.pre_end) for r in narrow.filter("more = 2 * id").collect()} == {i: v[:3] for i, v in walked(NODES, 1).items()}


def test_leaves_take_no_part_in_the_rounds(spark, monkeypatch):
    tables, write = {}, L.materialize

    def counting(df, label, *args, **kwargs):
        tables.setdefault(label, []).append(df.count())
        return write(df, label, *args, **kwargs)

    monkeypatch.setattr(L, "materialize", counting)
    L.label_hierarchy(spark.createDataFrame(NODES, SCHEMA))
    assert set(tables["sums"]) == set(tables["starts"]) == {4}


def test_repeated_ids_multiply_as_in_a_join(spark):
    tree = [(1, None, "r"), (2, 1, "b"), (3, 2, "c")]
    once = L.label_hierarchy(spark.createDataFrame(tree, SCHEMA))
    twice = L.label_hierarchy(spark.createDataFrame([*tree, (3, 2, "c")], SCHEMA))
    assert once.filter("id = 3").count() == 1
    # Two rows as they come, sized twice and placed in every one of them.
    assert twice.filter("id = 3").count() == 2 * 4 * 4


def test_level_order_of_stored_rows_without_paths(spark, monkeypatch):
    """Rows of one id are ordered by preorder numbers; no path is built."""
    tree = L.label_hierarchy(spark.createDataFrame(NODES, SCHEMA))
    placed = L.sibling_order(tree).withColumns({c: F.col("pre").cast("double") for c in ("x", "y", "r")})
    ranked = H.build_hierarchy(placed.select("id", "parent_id", "name", "ord"), order=[F.col("ord")])
    want = [r.name for r in ranked.orderBy("level", "path").collect()]

    def no_paths(*args, **kwargs):
        raise AssertionError("paths are built")

    monkeypatch.setattr(Y, "build_hierarchy", no_paths)
    got = Y.flatten_layout(placed).orderBy("id").collect()
    assert [r.name for r in got] == want and [r.id for r in got] == list(range(1, len(NODES) + 1))
    assert [r.parent_id for r in got][:3] == [None, 1, 1]


def test_many_shards_in_few_files(spark, tmp_path):
    """A folder per shard makes as many files as shards."""
    nodes = [(1, None, "r")] + [(10 + i, 1, f"f{i}") for i in range(60)] + [(1000 + 10 * i + j, 10 + i, f"l{j}") for i in range(60) for j in range(3)]
    path = str(tmp_path / "shards")
    manifest = A.write_shard_documents(L.label_hierarchy(spark.createDataFrame(nodes, SCHEMA)), path, max_bytes=200, max_children=5).collect()
    assert len(manifest) > 50
    files = list((tmp_path / "shards").rglob("*.json"))
    assert len(files) <= 8 and {f for r in manifest for f in r.files} <= {f.name for f in files}
    lines = spark.read.schema("shard_id bigint, id bigint, parent_id bigint, ord bigint").json(path).collect()
    assert len(lines) == sum(r.lines for r in manifest)
    for r in manifest:
        mine = [x for x in lines if x.shard_id == r.shard_id]
        assert len(mine) == r.lines and mine[0].id == r.shard_id  # the shard's node first
