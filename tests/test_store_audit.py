import os
import threading

from pyspark.sql import functions as F

from ramify import store
from ramify.functions import text as T
from ramify.operators import cleaning as C
from ramify.plans import views
from ramify.sources import nested as N
from ramify.sources import parts as A
from ramify.streaming import telemetry as M

NODE = "id bigint, parent_id bigint, name string"


def test_scopes_of_two_threads(spark):
    """A block that ends in one thread leaves the tables of another alone."""
    ready, ended, found = threading.Event(), threading.Event(), []

    def other():
        with store.transient(spark):
            table = store.materialize(spark.range(7), "other")
            ready.set()
            ended.wait(60)
            found.append(table.count())

    thread = threading.Thread(target=other)
    thread.start()
    assert ready.wait(60)
    with store.transient(spark):
        mine = store.materialize(spark.range(3), "mine").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(mine)
    ended.set()
    thread.join()
    assert found == [7] and not os.path.exists(mine)


def test_release_between_queries(spark):
    before = views.labelled(spark, "/root/testdata/sf0.001", "product").count()
    store.release(spark)
    assert views.labelled(spark, "/root/testdata/sf0.001", "product").count() == before


def test_audit_finds_a_missing_file(spark, tmp_path):
    nodes = spark.range(1, 41).select(F.col("id"), F.lit(1).cast("bigint").alias("parent_id"), F.lit("n").alias("name"), F.col("id").alias("bfs"))
    parts, manifest = str(tmp_path / "parts"), str(tmp_path / "manifest")
    A.write_layout_parts(A.split_parts(nodes, 4), parts, ["id", "parent_id", "name"], position="bfs")
    A.write_manifest(A.build_manifest(A.written_parts(spark, parts)), manifest)
    read = A.read_manifest(spark, manifest)
    assert A.manifest_audit(read, A.written_parts(spark, parts)).filter("not ok").count() == 0
    assert sorted(r.id for r in A.read_from_manifest(spark, manifest, parts)[0].collect()) == list(range(1, 41))
    lost = sorted((tmp_path / "parts" / "part=2").glob("*.json"))[0]
    lost.unlink()
    bad = {r.filename: (r.declared, r.found) for r in A.manifest_audit(read, A.written_parts(spark, parts)).filter("not ok").collect()}
    assert bad["total"] == (40, 40 - bad[f"part=2/{lost.name}"][0]) and len(bad) == 2


def test_damaged_parts_are_returned(spark, tmp_path, rows):
    path = tmp_path / "part.json"
    path.write_text('{"id":1,"name":"good"}\n{"id":2,\nnonsense\n{"name":"no id"}\n')
    good, rejected = A.read_layout_parts(spark, str(path), multi_line=False)
    assert rows(good, "id") == [(1,)]
    assert rejected.count() == 3


def test_part_names_and_counts_beyond_999(spark, rows):
    parted = spark.createDataFrame([(0, 1), (99, 2), (999, 3), (1000, 4)], "part int, id bigint")
    names = rows(A.part_stats(parted, ["id"], parts=1), "filename")
    assert names == [("tree_part_001.json",), ("tree_part_100.json",), ("tree_part_1000.json",), ("tree_part_1001.json",)]


def test_names_are_kept_whole(spark):
    docs = spark.createDataFrame([(1, '{"name":"x","children":[{"name":"%s"},{"name":"%s"}]}' % ("a" * 150, "b" * 5000))], "doc_id bigint, json string")
    assert sorted(len(r.name) for r in N.flatten_tree_json(docs).collect()) == [4, 150, 5000]


def test_highlight_is_linear(spark):
    long = "x" * 400_000
    marked = spark.createDataFrame([(long,), (long + "t-h-e",), ("T.h.E",)], "t string").select(T.highlight("t", "the").alias("m")).collect()
    assert [r.m for r in marked] == [long, long + "<mark>t</mark>-<mark>h</mark>-<mark>e</mark>", "<mark>T</mark>.<mark>h</mark>.<mark>E</mark>"]


def test_roots_are_no_duplicate_leaves(spark, rows):
    nodes = spark.createDataFrame([(1, None, "same"), (2, None, "same"), (3, 1, "leaf"), (4, 1, "Leaf")], NODE)
    assert rows(C.drop_duplicate_leaves(nodes), "id") == [(1,), (2,)]


def test_stream_waits_for_late_events(spark, tmp_path):
    """An event one second late finds its place."""
    path = str(tmp_path / "in")
    base = 1_700_000_000_000
    files = [[(1, base), (3, base + 1300)], [(2, base + 700), (4, base + 2400)], [(9, base + 10**8)]]
    schema = "event_id bigint, user_id bigint, ms bigint"
    for rows_ in files:
        frame = spark.createDataFrame([(i, 1, ms) for i, ms in rows_], schema)
        frame.select("event_id", "user_id", F.timestamp_millis("ms").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema("event_id bigint, user_id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out = M.ewma_lag_stream(events, "user_id", "ts", "event_id", delay="10 seconds")
    query = out.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.event_id: r.lag_ms for r in spark.table("late").collect()}
    batch = spark.read.schema("event_id bigint, user_id bigint, ts timestamp").parquet(path)
    want = {r.event_id: r.lag_ms for r in M.ewma_lag(batch, "user_id", "ts", "event_id").collect()}
    assert set(got) == {1, 2, 3, 4} and all(abs(got[k] - want[k]) < 1e-6 for k in got)
