import random

import pytest
from pyspark.sql import functions as F

from ramify.operators import labels as L
from ramify.operators import search as S
from test_text import score

NODE = "id bigint, parent_id bigint, name string"


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(1)
    words = ["fox", "red fox", "foxglove", "f o x", "ox", "grey wolf", "Fox", "xfoo", "box of x"]
    rows = [(1, None, "Life")]
    for i in range(2, 700):
        rows.append((i, rng.randint(1, max(1, i // 6)), rng.choice(words) + (f" {i}" if i % 3 else "")))
    return rows, L.label_hierarchy(spark.createDataFrame(rows, NODE))


def scored(rows, q):
    """(score, bonus, id, name) of every match, by plain Python."""
    parent = {i: p for i, p, _ in rows}
    name = {i: n for i, _, n in rows}
    kids = {}
    for i, p, _ in rows:
        kids.setdefault(p, []).append(i)

    def path(i):
        return [] if i is None else [*path(parent[i]), name[i]]

    for i, _, n in rows:
        names = path(i)
        s = score(n, q, len(kids.get(i, [])), len(names) - 1)
        if s > 0:
            full, up = " / ".join(names).lower(), " / ".join(names[:-1]).lower()
            yield s, (100 + (50 if q.lower() in up else 0)) if q.lower() in full else 0, i, n


@pytest.mark.parametrize("q", ["fox", "fx", "life", "grey", "zzz"])
def test_search_is_exact(tree, q):
    rows, labelled = tree
    want = sorted(scored(rows, q), key=lambda m: (-(m[0] + m[1]), m[3], m[2]))[:40]
    got = S.search(labelled, [q, " "], 40).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(m[2], m[0] + m[1]) for m in want]


def walked(rows):
    kids = {}
    for i, p, n in rows:
        kids.setdefault(p, []).append((n, i))
    stack, order = [i for _, i in sorted(kids[None])], []
    while stack:
        i = stack.pop()
        order.append(i)
        stack.extend(c for _, c in sorted(kids.get(i, [])))
    return order


@pytest.mark.parametrize("q,limit", [("fox", 30), ("ox", 10), ("fx", 20), ("red fox", 4)])
def test_search_first_candidates(tree, q, limit):
    rows, labelled = tree
    found = {m[2]: m for m in scored(rows, q)}
    cand = [found[i] for i in walked(rows) if i in found][: min(3 * limit, 500)]
    exact = [m for m in cand if m[0] >= 1000]
    if len(exact) >= limit:
        pool = [(m[0], m[3], m[2]) for m in exact]
    else:
        others = [m for m in cand if m[0] < 1000]
        pool = [(m[0], m[3], m[2]) for m in exact]
        pool += [(m[0] + (m[1] if k < 2 * limit else 0), m[3], m[2]) for k, m in enumerate(others)]
    want = sorted(pool, key=lambda m: (-m[0], m[1], m[2]))[:limit]
    got = S.search_first_candidates(labelled, [q], limit, min(3 * limit, 500)).orderBy("rank").collect()
    assert [(r["score"], r["name"], r["id"]) for r in got] == want


def test_search_results_path(spark):
    labelled = L.label_hierarchy(spark.createDataFrame([(1, None, "Life"), (2, 1, "A"), (3, 2, "cat")], NODE))
    got = S.search_results(S.search(labelled, ["cat", "life"])).collect()
    assert {(r["name"], r["path"]) for r in got} == {("cat", "Life / A"), ("Life", "")}
    assert S.search(labelled, ["", "  "]).count() == 0


def test_resolve_paths_like_a_walk(spark):
    rng = random.Random(3)
    rows = [(1, None, "Life")] + [(i, rng.randint(1, max(1, i // 3)), rng.choice("abc")) for i in range(2, 120)]
    labelled = L.label_hierarchy(spark.createDataFrame(rows, NODE))
    kids = {}
    for i, p, n in sorted(rows, key=lambda r: (r[2], r[0])):
        kids.setdefault(p, []).append((n, i))

    def resolve(path):
        parts = [p for p in path.split("/") if p]
        if parts and parts[0] == "Life":
            parts = parts[1:]
        node = 1
        for part in parts:
            child = next((i for n, i in kids.get(node, []) if n == part), None)
            if child is None:
                break
            node = child
        return node

    paths = ["", "/", "Life", "Life//a", "NOPE/a"] + [
        ("Life/" if k % 2 else "") + "/".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for k in range(80)
    ]
    asked = spark.createDataFrame(list(enumerate(paths)), "path_no int, path string")
    got = {r["path_no"]: r["id"] for r in S.resolve_paths(labelled, asked).collect()}
    assert got == {k: resolve(p) for k, p in enumerate(paths)}


def test_enrich(spark):
    nodes = spark.createDataFrame([(1, "Red Fox"), (2, "Wolf"), (3, "Newt")], "id int, name string")
    pages = spark.createDataFrame(
        [("red fox", "http://i/1", "a", "Q1"), ("RED FOX", "http://i/2", "b", "Q2"), ("Wolf", "file:///x", "c", None)],
        "title string, thumbnail string, extract string, wikibase_item string",
    )
    ranks = spark.createDataFrame([("Q2", "species"), ("Q2", "taxon")], "wikibase_item string, rank_label string")
    got = {r["id"]: (r["thumbnail"], r["extract"], r["caption"]) for r in S.enrich_nodes(nodes, pages, ranks).collect()}
    assert got == {1: ("http://i/2", "b", "Red Fox (species)"), 2: (None, "c", "Wolf"), 3: (None, None, "Newt")}


def test_search_terms_equals_search(spark, tree, rows):
    _, labelled = tree
    terms = ["fox", "o", "ox", "  wolf ", "", "zzz", "red fox", "x 1", "rx", "fx", "00", "Lf", "wlf", "r.d", "a|b", "lffe", "\\", "oo"]
    got = S.search_terms(labelled, spark.createDataFrame([(t,) for t in terms], "query string"))
    whole = S.search(labelled, terms)
    assert rows(got) == rows(whole.select("query", "rank", "id", "name", "score"))
    assert whole.filter(~F.contains(F.lower("name"), F.lower("query"))).count() > 0
    assert S.search_terms(labelled, spark.createDataFrame([], "query string")).count() == 0
    assert S.search_terms(labelled, spark.createDataFrame([("o",)], "query string"), limit=2).count() == 2


def test_search_terms_reads_no_pair_twice(spark):
    """Names of many characters, repeated ones, and a query found under one pair only."""
    names = ["", "a", "aa", "ab" * 300, "ba" * 300, "x" + "é" * 50 + "y", "é y", None]
    labelled = spark.createDataFrame([(i, n, [n or ""], 0, 1) for i, n in enumerate(names)], "id int, name string, path_names array<string>, child_count int, level int")
    asked = [("aab",), ("ba",), ("xéy",), ("aa",), ("É Y",), ("q",)]
    found = S.search_terms(labelled, spark.createDataFrame(asked, "query string"))
    want = S.search(labelled, [q for q, in asked])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.drop("path_names").collect()))
    plan = S.search_terms(labelled, spark.createDataFrame(asked, "query string"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
