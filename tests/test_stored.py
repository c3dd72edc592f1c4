"""Lookups on a table stored in buckets of its ids: same rows, and the node side is not shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from ramify.operators import labels as L
from ramify.sources.stored import store_for_lookup
from test_hierarchy import NODE, random_tree


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    labelled = L.label_hierarchy(spark.createDataFrame(random_tree(400, 21, 0.3), NODE))
    return labelled, store_for_lookup(labelled, "stored_nodes", str(tmp_path_factory.mktemp("stored") / "nodes"), 8)


def scans_under_exchange(df):
    """Names of shuffles that read the stored table without a join between."""
    plan, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for at, line in enumerate(plan):
        if "Exchange hashpartitioning" not in line:
            continue
        depth = line.index("Exchange")
        for below in plan[at + 1 :]:
            name = below.lstrip(" :+-*()0123456789")
            if len(below) - len(name) <= depth or "Join" in name.split(" ")[0]:
                break
            if "stored_nodes" in name:
                found.append(line)
                break
    return found


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def requests(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 420), rng.choice([None, rng.randint(0, 420)])) for _ in range(300)]
    return spark.createDataFrame(rows, "node_id bigint, current_id bigint")


def test_go_up(spark, both, no_broadcast, rows):
    labelled, stored = both
    asked = requests(spark, 1).select(F.col("node_id").alias("id"))
    found = L.go_up(stored, asked)
    assert scans_under_exchange(found) == []
    assert rows(found, "from_id", "id", "name") == rows(L.go_up(labelled, asked), "from_id", "id", "name")


def test_is_in_subtree(spark, both, no_broadcast, rows):
    labelled, stored = both
    pairs = requests(spark, 2)
    found = L.is_in_subtree(stored, pairs)
    assert scans_under_exchange(found) == []
    cols = ["node_id", "current_id", "inside"]
    assert rows(found, *cols) == rows(L.is_in_subtree(labelled, pairs), *cols)
    span = {r["id"]: (r["pre"], r["pre_end"]) for r in labelled.collect()}
    for node, current, inside in rows(found, *cols):
        known = node in span and current in span
        assert inside == (current is None or (known and span[current][0] <= span[node][0] <= span[current][1]))


def test_the_check_of_plans_sees_a_shuffle(spark, both, no_broadcast):
    _, stored = both
    assert scans_under_exchange(stored.groupBy("parent_id").count()) != []


def test_empty_table(spark, tmp_path):
    empty = store_for_lookup(spark.createDataFrame([], NODE), "stored_none", str(tmp_path / "none"), 4)
    assert L.go_up(empty, spark.range(3)).count() == 0
