"""Empty inputs and trees of one node."""

from ramify.operators import cleaning as C
from ramify.operators import labels as L
from ramify.operators import search as S
from ramify.sources import nested as N
from ramify.sources import parts as A
from ramify.streaming import telemetry as M


def test_one_node(spark):
    one = spark.createDataFrame([(1, None, "r")], "id bigint, parent_id bigint, name string")
    assert C.drop_placeholder_deep(one).count() == C.drop_placeholder_flat(one).count() == 1
    assert C.drop_duplicate_leaves(one).count() == 1
    labelled = L.label_hierarchy(one)
    assert labelled.select("pre", "pre_end", "leaf_count").first() == (1, 1, 1)
    assert A.shard_by_budget(labelled).count() == A.adjacency_export(labelled).count() == 0
    none = spark.createDataFrame([], "path_no int, path string")
    assert S.resolve_paths(labelled, none).count() == 0


def test_empty_documents_and_events(spark):
    docs = spark.createDataFrame([], "doc_id int, json string")
    assert N.flatten_tree_json(docs).count() == N.flatten_key_map(docs).count() == 0
    assert N.merge_key_maps(docs.withColumnRenamed("doc_id", "part_no")).count() == 0
    events = spark.createDataFrame([], "e bigint, k bigint, ts timestamp_ntz")
    assert M.ewma_lag(events, "k", "ts", "e").count() == 0
