"""Documents larger than a row, lookups without paths, placing and closing rules, against brute force."""

import json
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ramify.operators import labels as L
from ramify.operators import search as S
from ramify.operators import spatial as P
from ramify.sources import nested as N
from ramify.store import scratch_root
from ramify.streaming import telemetry as M

NODE = "id bigint, parent_id bigint, name string"
ODD = ["plain", 'quote " inside', "brace { and }", "[1, 2]", "back\\slash", '\\"{', "é ñ\n", "", "{{{{", "children", None, 7, True]


def random_tree(rng, depth):
    node = {"name": rng.choice(ODD), "size": rng.choice([1, "{", None, {"name": "no node", "children": [{"name": "nor this"}]}])}
    if rng.random() < 0.2:
        del node["name"]
    if depth and rng.random() < 0.8:
        kids = [random_tree(rng, depth - 1) if rng.random() < 0.85 else rng.choice([3, "x", None, [], [{"name": "in a list"}]]) for _ in range(rng.randint(0, 5))]
        node["children"] = rng.choice([kids, kids, kids, random_tree(rng, depth - 1), "none", None])
    return dict(rng.sample(list(node.items()), len(node)))


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_read_tree_json_equals_flatten(spark, tmp_path, small_splits, rows):
    rng = random.Random(5)
    docs = [random_tree(rng, 6) for _ in range(12)] + [[random_tree(rng, 4), 3, random_tree(rng, 3)], {"name": "alone"}, []]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i:02}.json").write_text(json.dumps(doc, ensure_ascii=i % 2 == 0, indent=i % 3 or None), encoding="utf-8")
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, json string")
    want = N.number_nodes(N.flatten_tree_json(table)).select("id", "parent_id", "name", "level")
    found = N.read_tree_json(spark, str(tmp_path))
    assert rows(found, "id", "parent_id", "name", "level") == rows(want)
    assert found.count() > 100
    values = N.read_json_values(spark, str(tmp_path))
    assert values.filter("depth = 0").count() == len(docs)


def test_one_large_document_is_read_by_many_tasks(spark, tmp_path):
    """30 MB in one document of one line; no row comes near its size."""
    kid = {"name": "n" * 90, "children": [{"name": "leaf"}]}
    text = json.dumps({"children": [kid] * 250_000})
    (tmp_path / "one.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        pieces = spark.read.option("lineSep", "{").text(str(tmp_path))
        assert pieces.rdd.getNumPartitions() > 10 and pieces.agg(F.max(F.length("value"))).first()[0] < 200
        found = N.read_tree_json(spark, str(tmp_path))
        assert {(r["level"], r["n"]) for r in found.groupBy("level").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, 250_000), (2, 250_000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_values_of_documents_cut_anywhere(spark, tmp_path, small_splits, rows):
    """Blocks that begin in strings, keys and deep containers, against a walk; names that come last."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    rng = random.Random(8)
    long = "{" * 250 + '\\"}]' + "a{" * 60
    chain = {"name": "end"}
    for i in range(5):
        chain = {"children": [{"name": long[i : i + 30]}, chain, [7]], 'key {"': [i, None], "name": f"late {i} {{"}
    docs = [[random_tree(rng, 3) for _ in range(3)], chain, {"a" + long: long, "children": {"name": long, "children": [{"children": []}]}}, [], 5, long]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in docs[:3]), encoding="utf-8")
    (tmp_path / "b.json").write_text(" ".join(json.dumps(d) for d in docs[3:]))
    want = []

    def walk(value, key, depth, parent):
        kind = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "null" if value is None else "scalar"
        want.append((len(want) + 1, parent, depth, key, kind, (value if isinstance(value, str) else json.dumps(value)) if kind == "scalar" else None))
        me = len(want)
        for k, v in value.items() if kind == "object" else [(None, v) for v in value] if kind == "array" else []:
            walk(v, k, depth + 1, me)

    for doc in docs:
        walk(doc, None, 0, None)
    assert rows(N.read_json_values(spark, str(tmp_path)), "id", "parent_id", "depth", "key", "kind", "text") == sorted(want, key=repr)
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs[:4])], "doc_id int, json string")
    nodes = N.number_nodes(N.flatten_tree_json(table)).select("id", "parent_id", "name", "level")
    assert rows(N.read_tree_json(spark, str(tmp_path)), "id", "parent_id", "name", "level") == rows(nodes)


def test_reading_a_tree_writes_little(spark, tmp_path, monkeypatch):
    """All tables written on the way are together not much larger than the text."""
    kid = '{"name":"kid %d","children":[{"name":"%s"},{"name":"5-LOW","children":{"name":"deep"}}]}'
    (tmp_path / "one.json").write_text("[" + ",".join(kid % (i, "FOP"[i % 3]) for i in range(150_000)) + "]")
    monkeypatch.setattr("ramify.store.drop_path", lambda spark, path: None)
    before = set(Path(scratch_root(spark)).rglob("*.parquet"))
    assert N.read_tree_json(spark, str(tmp_path)).count() == 600_001
    written = sum(f.stat().st_size for f in set(Path(scratch_root(spark)).rglob("*.parquet")) - before if f.is_file())
    assert written < 2.5 * (tmp_path / "one.json").stat().st_size


def test_read_key_map_equals_flatten(spark, tmp_path, small_splits):
    rng = random.Random(3)

    def value(depth):
        if not depth or rng.random() < 0.2:
            return rng.choice([{}, [], 1, "a{b", None, "x"])
        if rng.random() < 0.3:
            return [value(depth - 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice(["a", "b{", 'q"', "é"]) + str(i): value(depth - 1) for i in range(rng.randint(0, 4))}

    docs = [{"root": value(6), "other": value(4)} for _ in range(25)]
    (tmp_path / "all.json").write_text("\n".join(json.dumps(d) for d in docs))
    table = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "doc_id int, json string")
    want = Counter((tuple(r["path"]), r["level"], r["is_leaf"]) for r in N.flatten_key_map(table).collect())
    nodes = {r["id"]: r for r in N.read_key_map(spark, str(tmp_path)).collect()}

    def path(r):
        return (*(path(nodes[r["parent_id"]]) if r["parent_id"] else ()), r["name"])

    assert Counter((path(r), r["level"], r["is_leaf"]) for r in nodes.values()) == want


def test_unbalanced_documents_raise(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "children": [{"name": "y"}]')
    with pytest.raises(ValueError, match="not balanced"):
        N.read_tree_json(spark, str(tmp_path))


def test_lost_rows_drop_out_of_labels(spark, rows):
    table = [(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 99, "lost"), (5, 4, "below"), (6, 7, "x"), (7, 6, "y"), (8, 7, "tail"), (9, 8, "tail"), (10, 3, "c"), (11, 10, "d")]
    for paths in (True, False):
        found = L.label_hierarchy(spark.createDataFrame(table, NODE), paths=paths)
        assert rows(found, "id", "level", "pre", "subtree_size", "leaf_count") == [(1, 0, 1, 5, 1), (10, 3, 4, 2, 1), (11, 4, 5, 1, 1), (2, 1, 2, 4, 1), (3, 2, 3, 3, 1)]


def test_paths_are_resolved_in_a_deep_chain(spark):
    """100,000 levels; half-way is found by its path, without any path in the table."""
    depth = 100_000
    chain = spark.range(depth).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("name"))
    labelled = L.label_hierarchy(chain, paths=False)
    half = "/".join(f"n{i % 3}" for i in range(depth // 2))
    asked = spark.createDataFrame([(1, half), (2, half + "/nope/n1"), (3, "n0/n1/n1"), (4, "n1")], "path_no int, path string")
    found = {r["path_no"]: (r["id"], r["matched"]) for r in S.resolve_paths(labelled, asked).collect()}
    assert found == {1: (depth // 2 - 1, depth // 2 - 1), 2: (depth // 2 - 1, depth // 2 - 1), 3: (1, 1), 4: (1, 1)}


def test_preset_counts_without_paths(spark):
    rng = random.Random(9)
    parent = {1: None} | {i: rng.randint(max(1, i - 12), i - 1) for i in range(2, 400)}
    preset = {i: rng.choice([0, 0, 0, 0, 5, 11, None]) for i in parent}
    kids = defaultdict(list)
    for i, p in parent.items():
        kids[p].append(i)

    def leaves(i):
        return preset[i] or sum(map(leaves, kids[i])) if kids[i] else preset[i] or 1

    table = spark.createDataFrame([(i, p, f"n{i}", preset[i]) for i, p in parent.items()], NODE + ", preset int")
    found = L.leaf_counts(L.label_hierarchy(table, paths=False), "preset")
    assert {r["id"]: r["leaves"] for r in found.collect()} == {i: leaves(i) for i in parent}


def test_place_labels_equals_greedy(spark):
    rng = random.Random(4)
    rects = []
    for view, n, room in ((1, 300, 300.0), (2, 60, 2000.0), (3, 200, 40.0), (4, 1, 10.0)):
        for turn in range(1, n + 1):
            x, y, w, h = rng.uniform(-room, room), rng.uniform(-room, room), rng.uniform(1, 60), rng.choice([10.0, 14.0, 22.0])
            rects.append((view, view * 1000 + turn, turn, round(x), y, round(x) + w, y + h))
    want, kept = set(), defaultdict(list)
    for v, i, _, x1, y1, x2, y2 in sorted(rects, key=lambda r: (r[0], r[2])):
        if not any(x2 >= a and x1 <= c and y2 >= b and y1 <= d for a, b, c, d in kept[v]):
            kept[v].append((x1, y1, x2, y2))
            want.add((v, i))
    table = spark.createDataFrame([(v, i, t, float(a), b, c, d) for v, i, t, a, b, c, d in rects], "viewport_id int, id int, turn int, x1 double, y1 double, x2 double, y2 double")
    found = P.place_labels(table)
    assert {(r["viewport_id"], r["id"]) for r in found.collect()} == want
    assert P.place_labels(table.limit(0)).count() == 0


def test_event_rate_closing(spark):
    rng = random.Random(6)
    events = [(rng.choice("aaaaab"), rng.randint(0, 40_000), i) for i in range(600)] + [("c", 5, 1000)]
    table = spark.createDataFrame(events, "k string, ms long, nr int").withColumn("ts", F.timestamp_millis("ms"))
    found = M.event_rate_closing(table, "k", "ts", "nr", 125).select("k", F.unix_millis("started"), F.unix_millis("closed"), "events", "rate", "ms_per_event")
    want = []
    for key in "abc":
        times = sorted((t, i) for k, t, i in events if k == key)
        last, count = times[0][0], 0
        for t, _ in times[1:]:
            count += 1
            if t - last >= 125:
                rate = int(count / ((t - last) / 1000) + 0.5)
                want.append((key, last, t, count, rate, int(1000 / rate + 0.5) if rate else 0))
                last, count = t, 0
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert M.event_rate_closing(table.limit(0), "k", "ts", "nr").count() == 0
