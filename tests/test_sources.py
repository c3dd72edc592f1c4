import json

import pytest
from pyspark.sql import functions as F

from ramify.operators import cleaning as C
from ramify.sources import nested as N
from ramify.sources import parts as A
from ramify.sources import taxonomy as X


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_opentree_taxonomy(spark, tmp_path, rows):
    text = "\n".join(
        [
            "ott_id\t|\tparent_id\t|\tname\t|\trank",
            "1\t|\t\t|\tlife\t|\tno rank\t|\t\t|",
            "2\t1\tplain tabs\tgenus",
            "3\t|\t1\t|\tthree fields",
            "x1\t|\t1\t|\tbad id\t|\tgenus\t|",
            "12abc\t|\t1\t|\tlead digits\t|\tgenus\t|\t\t|",
            "4\t|\t1\t|\t \t|\t \t|\t\t|",
            "2\t|\t4\t|\tlast wins\t|\tfamily\t|\t\t|",
            "",
        ]
    )
    got, _ = X.read_opentree_taxonomy(spark, write(tmp_path, "taxonomy.tsv", text))
    assert rows(got, "id", "parent_id", "name", "rank") == sorted(
        [
            (1, None, "life", "no rank"),
            (2, 4, "last wins", "family"),
            (12, 1, "lead digits", "genus"),
            (4, 1, "Unknown_4", "no rank"),
        ],
        key=repr,
    )
    rejected = X.parse_opentree_taxonomy(X.read_lines(spark, str(tmp_path / "taxonomy.tsv")))[1]
    assert {r["value"].split("\t")[0] for r in rejected.collect()} == {"3", "x1"}


def test_opentree_without_header_keeps_first_line(spark, tmp_path):
    path = write(tmp_path, "t.tsv", "7\t|\t\t|\tlife\t|\tno rank\n")
    assert X.read_opentree_taxonomy(spark, path)[0].count() == 1


def test_synonyms_and_best_common_name(spark, tmp_path, rows):
    lines = [
        "name\t|\tuid\t|\ttype\t|\tuniqname\t|\tsourceinfo",
        "big cat\t|\t1\t|\tsynonym\t|\t\t|\tgbif",
        "sly cat\t|\t1\t|\tsynonym\t|\t\t|\tgbif",
        "a cat\t|\t1\t|\tsynonym\t|\t\t|\tprotocol 7",
        "felid\t|\t2\t|\tsynonym\t|\t\t|\tNCBI",
        "short line\t|\t2\t|\tsynonym\t|\tx",
        "tiny\t|\t2\t|\tsynonym\t|\t\t|\t",
        "Felis\t|\t3\t|\tsynonym\t|\t\t|\tgbif",
        " \t|\t3\t|\tsynonym\t|\t\t|\tgbif",
    ]
    synonyms, _ = X.read_opentree_synonyms(spark, write(tmp_path, "synonyms.tsv", "\n".join(lines)))
    assert rows(synonyms, "synonym", "source")[-1] == ("tiny", "")
    assert rows(C.best_common_name(synonyms)) == [(1, "big cat"), (2, "tiny")]
    assert X.read_opentree_synonyms(spark, str(tmp_path / "missing.tsv"))[0].count() == 0


def test_synonym_header_only_on_first_line(spark, tmp_path, rows):
    path = write(tmp_path, "s.tsv", "nameless frog\t|\t5\nnameless toad\t|\t6\n")
    assert rows(X.read_opentree_synonyms(spark, path)[0], "synonym") == [("nameless toad",)]


def test_ncbi(spark, tmp_path, rows):
    nodes = "1\t|\t1\t|\tno rank\t|\t\t|\n2\t|\t1\t|\tgenus\t|\tXX\t|\n2\t|\t1\t|\tspecies\t|\tXX\t|\nbad line\n"
    names = (
        "1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tOld\t|\t\t|\tscientific name\t|\n"
        "2\t|\tNew\t|\t\t|\tscientific name\t|\n2\t|\tcommon\t|\t\t|\tgenbank common name\t|\n3\t|\tx\n"
    )
    got, _ = X.read_ncbi_nodes(spark, write(tmp_path, "nodes.dmp", nodes))
    assert rows(got, "id", "parent_id", "rank") == [(1, 1, "no rank"), (2, 1, "species")]
    named, _ = X.read_ncbi_names(spark, write(tmp_path, "names.dmp", names))
    assert named.count() == 4
    assert rows(C.last_scientific_name(named)) == [(1, "root"), (2, "New")]


def test_layout_parts_and_manifest(spark, tmp_path, rows):
    one = [{"id": 1, "parent_id": None, "name": "Life", "level": 0, "x": 0, "y": 0, "r": 2}]
    two = [{"id": 2, "parent_id": 1, "name": "a", "level": 1, "x": 0.5, "y": 0, "r": 1}]
    p1 = write(tmp_path, "p1.json", json.dumps(one))
    p2 = write(tmp_path, "p2.json", json.dumps(two))
    p3 = write(tmp_path, "p3.json", json.dumps({"note": "no array"}))
    assert rows(A.read_layout_parts(spark, [p1, p2, p3])[0], "id", "name", "r") == [(1, "Life", 2.0), (2, "a", 1.0)]
    manifest = {
        "version": "1.0", "layout_size": 4000, "layout_padding": 0, "total_nodes": 3, "total_files": 2,
        "files": [{"filename": "p1.json", "nodes_count": 1, "size_bytes": 9}, {"filename": "p2.json", "nodes_count": 2, "size_bytes": 9}],
    }
    good = A.read_manifest(spark, write(tmp_path, "m.json", json.dumps(manifest)))
    observed = spark.createDataFrame([("p1.json", 1), ("p2.json", 1)], "filename string, nodes_count bigint")
    audit = {r["filename"]: r["ok"] for r in A.manifest_audit(good, observed).collect()}
    assert audit == {"p1.json": True, "p2.json": False, "total": False}
    del manifest["files"]
    bad = A.read_manifest(spark, write(tmp_path, "bad.json", json.dumps(manifest)))
    with pytest.raises(Exception, match="manifest lacks"):
        bad.collect()


@pytest.mark.parametrize("total,parts,sizes", [(11, 5, [3, 3, 3, 2, 0]), (3, 5, [1, 1, 1, 0, 0]), (10, 5, [2] * 5)])
def test_part_sizes(spark, total, parts, sizes):
    rows = spark.range(1, total + 1).withColumnRenamed("id", "bfs")
    stats = A.part_stats(A.split_parts(rows, parts), ["bfs"], parts).orderBy("part").collect()
    assert [r["nodes_count"] for r in stats] == sizes
    assert [r["size_bytes"] for r in stats if r["nodes_count"] == 0] == [2] * sizes.count(0)


def test_written_part_has_the_counted_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "é"), (2, 1, "b")], "id bigint, parent_id bigint, name string")
    stats = A.part_stats(rows.withColumn("part", F.lit(0)), ["id", "parent_id", "name"], 1).first()
    array = '[{"id":1,"parent_id":null,"name":"é"},{"id":2,"parent_id":1,"name":"b"}]'
    assert stats["size_bytes"] == len(array.encode())


def test_flatten_tree_json(spark, rows):
    docs = spark.createDataFrame(
        [
            (1, '{"name":"x","rank":"r","children":[{"name":"a","children":[{"name":"b"},{"children":{"name":"q"}}]},{"name":"c","children":null},5]}'),
            (2, '[{"name":"k"},"text"]'),
            (3, '{"children":{"name":"only"}}'),
            (4, '{"name":"' + "n" * 150 + '","children":[{"name":"' + "m" * 150 + '"}]}'),
        ],
        "doc_id int, json string",
    )
    flat = N.flatten_tree_json(docs)
    got = {(r["doc_id"], tuple(r["path"])): (r["name"], r["child_count"]) for r in flat.collect()}
    assert got[(1, ())] == ("Life", 2)
    assert got[(1, (0, 1))] == ("Unnamed", 1)
    assert got[(1, (0, 1, 0))] == ("q", 0)
    assert got[(2, (0,))] == ("k", 0) and (2, (1,)) not in got
    assert got[(3, (0,))] == ("only", 0)
    assert got[(4, (0,))][0] == "m" * 150
    numbered = rows(N.number_nodes(flat.filter("doc_id = 1")), "id", "parent_id", "name")
    assert [(r[0], r[1]) for r in numbered] == [(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (6, 1)]


def merged(parts):
    """The merge by plain dictionaries, for comparison."""

    def merge(into, new):
        for key, value in new.items():
            if isinstance(value, dict):
                if not isinstance(into.get(key), dict):
                    into[key] = {}
                merge(into[key], value)
            else:
                into[key] = value

    whole = {}
    for part in parts:
        merge(whole, part)

    def paths(value, path):
        members = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else []
        for key, v in members:
            yield (*path, str(key))
            yield from paths(v, (*path, str(key)))

    return sorted(paths(whole, ()))


@pytest.mark.parametrize(
    "parts",
    [
        [{"a": {"b": {"c": {}}, "d": 1}}, {"a": {"b": 3, "d": {"z": {}}}}, {"a": {"b": {}}}],
        [{"a": {"b": {"c": {}}}}, {"a": {}}, {"a": {"e": 1}}],
        [{"a": [{"f": 1}, 2]}, {"a": {"g": {}}}, {"b": {"x": [1]}}],
        [{"a": {"g": {}}}, {"a": [{"f": {"h": 1}}, 2]}, {"c": 1}],
        [{"a": [1]}, {"a": [{"k": 2}, 3]}, {"a": {"k": 1}}, {"a": 5}],
    ],
)
def test_merge_key_maps(spark, parts):
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(parts)], "part_no int, json string")
    got = N.merge_key_maps(df).collect()
    paths = sorted(tuple(r["path"]) for r in got)
    assert paths == merged(parts)
    leaves = {tuple(r["path"]) for r in got if r["is_leaf"]}
    assert leaves == {p for p in paths if not any(q[: len(p)] == p and len(q) > len(p) for q in paths)}
