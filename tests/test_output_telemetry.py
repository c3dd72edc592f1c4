import json
import random

import pytest
from pyspark.sql import functions as F

from ramify.operators import labels as L
from ramify.plans import bake as B
from ramify.sources import parts as A
from ramify.streaming import telemetry as M
from test_hierarchy import random_tree

NODE = "id bigint, parent_id bigint, name string"


def shards(rows, max_bytes, max_children):
    """Shards by a plain walk over nested dictionaries, for comparison."""
    kids, name = {}, {}
    for i, p, n in rows:
        kids.setdefault(p, []).append((n, i))
        name[i] = n
    dump = lambda v: json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    def leaves(i):
        return sum(leaves(c) for _, c in kids[i]) if i in kids else 1

    def shallow(i, level):
        return {"name": name[i], "level": level, "_leaves": leaves(i)}

    out = set()
    todo = [(kids[None][0][1], 0, [name[kids[None][0][1]]])]
    path = lambda parts: "data/" + "/".join(parts) + ".json"
    while todo:
        i, level, parts = todo.pop()
        node = {**shallow(i, level), "children": []}
        for n, c in sorted(kids.get(i, [])):
            grand = sorted(kids.get(c, []))
            test = {**shallow(c, level + 1), "children": [shallow(g, level + 2) for _, g in grand]}
            big = 2 + len(dump(node)) + len(dump(test)) > max_bytes or len(node["children"]) >= max_children
            if big and grand:
                node["children"].append({**shallow(c, level + 1), "_shard": path([*parts, n])})
                out.add((i, c, True, path([*parts, n])))
                todo.append((c, level + 1, [*parts, n]))
            else:
                inlined = []
                for gn, g in grand:
                    stub = shallow(g, level + 2)
                    ref = path([*parts, n, gn]) if g in kids else None
                    if ref:
                        stub["_shard"] = ref
                        todo.append((g, level + 2, [*parts, n, gn]))
                    inlined.append(stub)
                    out.add((i, g, True, ref))
                node["children"].append({**shallow(c, level + 1), "children": inlined})
                out.add((i, c, False, None))
    return out


@pytest.mark.parametrize(
    "max_bytes,max_children", [(25_000_000, 1_000_000), (300, 1000), (700, 1000), (2000, 1000), (10_000_000, 4), (1500, 12), (0, 0)]
)
def test_shards_match_a_walk(spark, max_bytes, max_children):
    rows = [(i, p, f"{n}-{i}") for i, p, n in random_tree(220, 11, 0.3)]
    labelled = L.label_hierarchy(spark.createDataFrame(rows, NODE))
    got = A.shard_by_budget(labelled, max_bytes, max_children).collect()
    assert {(r["shard_id"], r["child_id"], r["is_stub"], r["shard_ref"]) for r in got} == shards(rows, max_bytes, max_children)
    # Every node but the root is written once.
    assert sorted(r["child_id"] for r in got) == sorted(i for i, p, _ in rows if p)


@pytest.mark.parametrize("chunk,max_bytes", [(1, 700), (3, 1500), (7, 3000)])
def test_shards_match_a_walk_in_small_chunks(spark, monkeypatch, chunk, max_bytes):
    monkeypatch.setattr(A, "FOLD_CHUNK", chunk)
    rows = [(i, p, f"{n}-{i}") for i, p, n in random_tree(220, 13, 0.3)]
    got = A.shard_by_budget(L.label_hierarchy(spark.createDataFrame(rows, NODE)), max_bytes).collect()
    assert {(r["shard_id"], r["child_id"], r["is_stub"], r["shard_ref"]) for r in got} == shards(rows, max_bytes, 1_000_000)


@pytest.mark.parametrize("max_bytes", [60_000, 150_000])
def test_wide_family_is_folded_in_chunks(spark, monkeypatch, max_bytes):
    monkeypatch.setattr(A, "FOLD_CHUNK", 64)
    rng = random.Random(5)
    rows = [(1, None, "root")] + [(i, 1, "n" * rng.randint(1, 40) + f"-{i}") for i in range(2, 1502)]
    for i in range(2, 1502):
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            rows.append((len(rows) + 1, i, "c" * rng.randint(1, 90) + f"-{len(rows) + 1}"))
    cut = A.shard_by_budget(L.label_hierarchy(spark.createDataFrame(rows, NODE)), max_bytes)
    got = {(r["shard_id"], r["child_id"], r["is_stub"], r["shard_ref"]) for r in cut.collect()}
    assert got == shards(rows, max_bytes, 1_000_000)
    assert len({is_stub for shard, _, is_stub, ref in got if shard == 1 and ref}) == 1 and any(not r[2] for r in got if r[0] == 1)


def test_step_functions_of_many_chunks_chain(spark):
    """A family folded on its own: the bytes before each chunk follow from the chunks' functions."""
    rng = random.Random(8)
    budget, opening, rows, so_far, least, most, want = 40_000, 100, [], 100, 100, 100, {}
    for n in range(1, 2001):
        tested, stub, inlined, children = rng.randint(100, 9000), rng.randint(20, 60), rng.randint(20, 60), rng.randint(0, 1)
        if not children:
            stub = inlined
        comma = int(n > 1)
        rows.append((n, 7, n, children, None if children else False, tested, inlined, stub, least, most))
        want[n] = bool(children) and 2 + so_far + tested > budget
        so_far += (stub if want[n] else inlined) + comma
        least += min(stub, inlined) + comma
        most += max(stub, inlined) + comma
    columns = "id long, parent_id long, ord long, child_count long, cut boolean, tested long, inlined long, stub long, _least long, _most long"
    got = A._folded_cuts(spark.createDataFrame(rows, columns), budget)
    assert {r["id"]: r["folded"] for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_adjacency_chunks(spark):
    rows = random_tree(150, 12, 0.5)
    labelled = L.label_hierarchy(spark.createDataFrame(rows, NODE))
    out = A.adjacency_export(labelled, 7).collect()
    assert max(len(r["children"]) for r in out) == 7
    lists = {}
    for r in sorted(out, key=lambda r: (r["id"], r["chunk"])):
        lists.setdefault(r["id"], []).extend(c["id"] for c in r["children"])
    kids = {}
    for i, p, n in rows:
        if p:
            kids.setdefault(p, []).append((n, i))
    assert lists == {p: [i for _, i in sorted(c)] for p, c in kids.items()}


EVENT = "event_id bigint, user_id bigint, ts timestamp_ntz"


def event_rows(n=400, seed=1):
    rng = random.Random(seed)
    clock = {u: 1_700_000_000_000 for u in range(3)}
    rows = []
    for i in range(n):
        u = 0 if i % 3 else rng.randint(0, 2)
        clock[u] += rng.choice([500, 700, 400, 500, 900, 100])
        rows.append((i, u, clock[u]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, ms bigint").select(
        "event_id", "user_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts")
    )


def lags(rows):
    state, out = {}, {}
    for i, u, ms in rows:
        lag, last = state.get(u, (0.0, None))
        if last is not None:
            lag = max(0.0, 0.2 * (ms - last - 500) + 0.8 * lag)
        state[u] = (lag, ms)
        out[i] = lag
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_ewma_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(M, "_BLOCK", block)
    rows = event_rows()
    got = {r["event_id"]: r["lag_ms"] for r in M.ewma_lag(frame(spark, rows), "user_id", "ts", "event_id").collect()}
    assert got == pytest.approx(lags(rows), abs=1e-6)


def test_documented_gaps(spark):
    ms = [0, 500, 1200, 1600, 2100]
    rows = [(i, 1, 1_700_000_000_000 + m) for i, m in enumerate(ms)]
    got = M.ewma_lag(frame(spark, rows), "user_id", "ts", "event_id").orderBy("event_id").collect()
    assert [round(r["lag_ms"], 3) for r in got] == [0.0, 0.0, 40.0, 12.0, 9.6]
    assert [r["alert"] for r in got] == [False, False, True, True, True]


def stream(spark, tmp_path, df, files):
    path = str(tmp_path / "events")
    for i in range(files):
        df.filter(F.floor(F.col("event_id") / (400 / files)) == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_streamed_lag_equals_batch(spark, tmp_path):
    rows = event_rows()
    df = frame(spark, rows).withColumn("ts", F.col("ts").cast("timestamp"))
    # One event far ahead moves the watermark past all others.
    ahead = frame(spark, [(399_999, -1, rows[-1][2] + 10**9)]).withColumn("ts", F.col("ts").cast("timestamp"))
    live = stream(spark, tmp_path, df, 3)
    ahead.write.mode("append").parquet(str(tmp_path / "events"))
    out = M.ewma_lag_stream(live, "user_id", "ts", "event_id")
    drain(out.writeStream.format("memory").queryName("lags").option("checkpointLocation", str(tmp_path / "cp")).start())
    got = {r["event_id"]: r["lag_ms"] for r in spark.table("lags").filter("user_id >= 0").collect()}
    assert got == pytest.approx(lags(rows), abs=1e-6)


def test_streamed_rate_equals_batch(spark, tmp_path):
    df = frame(spark, event_rows()).withColumn("ts", F.col("ts").cast("timestamp"))
    batch = M.event_rate(df, "user_id", "ts", 1000)
    live = M.event_rate(stream(spark, tmp_path, df, 3).withWatermark("ts", "1 minute"), "user_id", "ts", 1000)
    drain(live.writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).start())
    last = spark.table("rates").groupBy("user_id", "window_start").agg(F.max_by(F.struct("rate", "ms_per_event"), "events").alias("r"), F.max("events").alias("events"))
    got = {(r["user_id"], r["window_start"]): (r["events"], r["r"]["rate"], r["r"]["ms_per_event"]) for r in last.collect()}
    want = {(r["user_id"], r["window_start"]): (r["events"], r["rate"], r["ms_per_event"]) for r in batch.collect()}
    assert got == want


def test_bake_opentree(spark, tmp_path):
    bar = "\t|\t"
    taxonomy = [
        ("1", "", "life", "no rank"), ("2", "1", "Felidae", "family"), ("3", "2", "sibling_higher", "no rank"),
        ("4", "3", "Felis catus", "species"), ("5", "2", "Panthera leo", "species"), ("6", "1", "Dup", "genus"),
        ("7", "2", "dup", "genus"), ("8", "99", "lost", "genus"),
    ]
    lines = ["ott_id" + bar + "parent_id" + bar + "name" + bar + "rank"] + [bar.join([*r, "", ""]) for r in taxonomy]
    (tmp_path / "taxonomy.tsv").write_text("\n".join(lines))
    (tmp_path / "synonyms.tsv").write_text("name" + bar + "uid\n" + bar.join(["house cat", "4", "s", "", "gbif"]))
    nodes, rejected = B.opentree_nodes(spark, str(tmp_path / "taxonomy.tsv"), str(tmp_path / "synonyms.tsv"))
    baked = B.bake_layout(nodes)
    manifest = B.write_bake(baked, str(tmp_path / "out")).first()
    assert manifest["total_nodes"] == 4 and [f["nodes_count"] for f in manifest["files"]] == [1, 1, 1, 1] and rejected.count() == 0
    stored = A.read_from_manifest(spark, str(tmp_path / "out" / "manifest"), str(tmp_path / "out" / "parts"))[0].orderBy("id").collect()
    assert [(r["id"], r["parent_id"], r["name"], r["level"]) for r in stored] == [
        (1, None, "Life", 0), (2, 1, "Felidae", 1), (3, 2, "Panthera Leo", 2), (4, 2, "House Cat (Felis Catus)", 2),
    ]
    assert stored[0]["r"] == 2000.0


def test_bake_ncbi(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\tX\t|\n2\t|\t1\t|\tgenus\t|\tX\t|\n3\t|\t2\t|\tspecies\t|\tX\t|\n")
    (tmp_path / "names.dmp").write_text("2\t|\tFelis\t|\t\t|\tscientific name\t|\n")
    baked = B.bake_layout(B.ncbi_nodes(spark, str(tmp_path / "nodes.dmp"), str(tmp_path / "names.dmp"))[0])
    assert [(r["name"], r["level"]) for r in baked.orderBy("id").collect()] == [("Life", 0), ("Felis", 1), ("Unknown_3", 2)]
