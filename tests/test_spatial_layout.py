import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ramify.operators import labels as L
from ramify.operators import layout as Y
from ramify.operators import spatial as P
from ramify.operators.enclosing import enclosing_circles
from test_hierarchy import random_tree

NODE = "id bigint, parent_id bigint, name string"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 50, 400, 4096, 4097])
@pytest.mark.parametrize("kind", ["equal", "mixed", "heavy"])
def test_packing_invariants(spark, n, kind):
    rng = np.random.default_rng(n)
    r = {"equal": np.ones(n), "mixed": rng.random(n) + 0.1, "heavy": np.sort(np.exp(rng.normal(0, 1.5, n)))[::-1]}[kind]
    circles = spark.createDataFrame([(1, i, i + 1, float(v)) for i, v in enumerate(r)], "family bigint, id bigint, ord bigint, r double")
    found = Y.pack_families(circles).orderBy("id").toPandas()
    x, y, whole = found.dx.to_numpy(), found.dy.to_numpy(), found.whole[0]
    assert len(found) == n and found.whole.nunique() == 1
    assert (np.hypot(x, y) + r <= whole * (1 + 1e-9)).all()
    gap = np.hypot(x[:, None] - x, y[:, None] - y) - r[:, None] - r
    np.fill_diagonal(gap, 0)
    assert gap.min() > -1e-6 * r.max()
    if n >= 50:
        assert (r**2).sum() / whole**2 > {"equal": 0.6, "mixed": 0.3, "heavy": 0.2}[kind]


def test_no_jump_between_family_sizes(spark):
    """The radius of a family of equal circles grows by at most one ring per circle."""
    rows = [(n, i, i + 1, 1.0) for n in (4095, 4096, 4097, 4098) for i in range(n)]
    found = Y.pack_families(spark.createDataFrame(rows, "family bigint, id bigint, ord bigint, r double"))
    whole = [r.w for r in found.groupBy("family").agg(F.max("whole").alias("w")).orderBy("family").collect()]
    assert max(whole) - min(whole) < 2 + 1e-9


def check_layout(laid_out, size, slack=1e-6):
    rows = {r["id"]: r for r in laid_out.collect()}
    kids = {}
    for r in rows.values():
        if r["level"] > 0:
            kids.setdefault(r["parent_id"], []).append(r)
            p = rows[r["parent_id"]]
            assert math.hypot(r["x"] - p["x"], r["y"] - p["y"]) + r["r"] <= p["r"] + slack * size
    for family in kids.values():
        x, y, r = (np.array([k[c] for k in family]) for c in ("x", "y", "r"))
        gap = np.hypot(x[:, None] - x, y[:, None] - y) - r[:, None] - r
        np.fill_diagonal(gap, 0)
        assert gap.min() >= -slack * size
    root = next(r for r in rows.values() if r["level"] == 0)
    assert (root["x"], root["y"]) == (0, 0) and math.isclose(root["r"], size / 2)
    return rows


@pytest.mark.parametrize(
    "options",
    [{}, {"value": "node", "strategy": "name"}, {"padding": 3.0}, {"value": "depth_weighted", "strategy": "children_desc"}],
)
def test_circle_layout(spark, options):
    labelled = L.label_hierarchy(spark.createDataFrame(random_tree(160, 8, 0.4), NODE))
    rows = check_layout(Y.circle_layout(labelled, size=1000.0, **options), 1000.0)
    assert len(rows) == 160
    if not options:
        areas = {i: r["r"] ** 2 / r["value"] for i, r in rows.items() if r["child_count"] == 0}
        assert max(areas.values()) / min(areas.values()) < 1 + 1e-9


def brute_smallest(circles):
    """Radius by ternary search over the centre: the largest reach is convex in it."""
    def reach(x, y):
        return max(math.hypot(u - x, v - y) + r for u, v, r in circles)

    def best_y(x):
        a, b = min(v - r for _, v, r in circles), max(v + r for _, v, r in circles)
        for _ in range(90):
            p, q = a + (b - a) / 3, b - (b - a) / 3
            a, b = (a, q) if reach(x, p) < reach(x, q) else (p, b)
        return reach(x, (a + b) / 2)

    a, b = min(u - r for u, _, r in circles), max(u + r for u, _, r in circles)
    for _ in range(90):
        p, q = a + (b - a) / 3, b - (b - a) / 3
        a, b = (a, q) if best_y(p) < best_y(q) else (p, b)
    return best_y((a + b) / 2)


def test_enclosing_circles(spark):
    """Families of one, few, equal, nested and many circles, against a search of the centre."""
    rng = random.Random(12)
    families = {0: [(1.0, 2.0, 3.0)], 1: [(0.0, 0.0, 1.0)] * 5, 2: [(0.0, 0.0, 5.0), (1.0, 0.0, 1.0)], 3: [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0)]}
    for f in range(4, 16):
        families[f] = [(rng.gauss(0, 5), rng.gauss(0, 5), rng.choice([0.0, 1.0, rng.random() * 4])) for _ in range(rng.randrange(2, 30))]
    families[16] = [(float(x), 0.0, 1.0) for x in range(20)]
    large = [(rng.gauss(0, 5), rng.gauss(0, 9), rng.random()) for _ in range(3000)]
    rows = [(f, *c) for f, cs in (families | {17: large}).items() for c in cs] + [(None, 0.0, 0.0, 1.0), (3, None, 0.0, 1.0)]
    found = {r["family"]: r for r in enclosing_circles(spark.createDataFrame(rows, "family int, x double, y double, r double")).collect()}
    assert set(found) == set(families) | {17}
    for f, circles in families.items():
        assert found[f]["radius"] == pytest.approx(brute_smallest(circles), abs=1e-6)
    c = found[17]
    out = [math.hypot(x - c["cx"], y - c["cy"]) + r for x, y, r in large]
    assert max(out) == pytest.approx(c["radius"], abs=1e-6)
    near = [k for k, o in zip(large, out) if o > c["radius"] * 0.9]
    assert c["radius"] == pytest.approx(brute_smallest(near), abs=1e-6)


@pytest.mark.parametrize("padding", [0.0, 2.0])
def test_tight_layout(spark, padding):
    labelled = L.label_hierarchy(spark.createDataFrame(random_tree(60, 9), NODE))
    loose = check_layout(Y.circle_layout(labelled, size=1000.0, padding=padding), 1000.0)
    rows = check_layout(Y.circle_layout(labelled, size=1000.0, padding=padding, tight=True), 1000.0)
    leaves = [sum(r["r"] ** 2 for r in x.values() if r["child_count"] == 0) for x in (loose, rows)]
    assert leaves[1] >= leaves[0]
    if not padding:
        for i, parent in rows.items():
            family = [(r["x"], r["y"], r["r"]) for r in rows.values() if r["parent_id"] == i and r["level"] > 0]
            if family:
                assert parent["r"] == pytest.approx(brute_smallest(family), rel=1e-6)


def test_layout_of_one_node_and_flat_rows(spark):
    single = L.label_hierarchy(spark.createDataFrame([(5, None, "only")], NODE))
    assert Y.circle_layout(single).select("x", "y", "r").first() == (0.0, 0.0, 2000.0)
    labelled = L.label_hierarchy(spark.createDataFrame(random_tree(60, 9), NODE))
    flat = {r["id"]: r for r in Y.flatten_layout(Y.circle_layout(labelled)).collect()}
    assert sorted(flat) == list(range(1, 61)) and flat[1]["parent_id"] is None
    last = (0, 0)
    for i in range(2, 61):
        now = (flat[i]["level"], flat[i]["parent_id"])
        assert flat[i]["parent_id"] < i and now >= last
        last = now
        assert round(flat[i]["r"], 2) == flat[i]["r"]


@pytest.fixture(scope="module")
def nested_circles(spark):
    rng = random.Random(4)
    rows = [(1, None, "root", 0.0, 0.0, 2000.0)]
    for i in range(2, 260):
        _, _, _, px, py, pr = rows[rng.randrange(len(rows))]
        parent = next(r[0] for r in rows if (r[3], r[4], r[5]) == (px, py, pr))
        r = pr * rng.uniform(0.05, 1.0)
        a, d = rng.uniform(0, 2 * math.pi), (pr - r) * rng.random()
        rows.append((i, parent, f"n{i}", px + d * math.cos(a), py + d * math.sin(a), r))
    rows.append((900, 1, "same", 0.0, 0.0, 2000.0))
    rows.append((901, 1, "dot", 10.0, 10.0, 0.0))
    labelled = L.label_hierarchy(spark.createDataFrame(rows, NODE + ", x double, y double, r double"))
    return labelled, [r.asDict() for r in labelled.collect()]


def test_pick_against_brute_force(spark, nested_circles):
    labelled, nodes = nested_circles
    rng = random.Random(5)
    points = []
    for i in range(300):
        wx, wy = rng.uniform(-2100, 2100), rng.uniform(-2100, 2100)
        points.append((i, wx, wy, wx + rng.uniform(-30, 30), wy, rng.choice([0.05, 0.5, 3.0]), 1200.0, 800.0, rng.choice([None, 3, 7, 900])))
    schema = "point_id int, wx double, wy double, cam_x double, cam_y double, k double, w double, h double, current_id bigint"
    got = {r["point_id"]: r["id"] for r in P.pick(labelled, spark.createDataFrame(points, schema)).collect()}
    by_id = {n["id"]: n for n in nodes}
    want = {}
    for i, wx, wy, cx, cy, k, w, h, cur in points:
        reach = math.sqrt(w * w + h * h) * 0.5 / k
        hits = [
            n for n in nodes
            if (n["x"] - wx) ** 2 + (n["y"] - wy) ** 2 <= n["r"] ** 2 and n["r"] * k >= 10
            and (n["x"] - cx) ** 2 + (n["y"] - cy) ** 2 <= (reach + n["r"]) ** 2
            and (cur is None or by_id[cur]["pre"] <= n["pre"] <= by_id[cur]["pre_end"])
        ]
        if hits:
            want[i] = max(hits, key=lambda n: (n["level"], -n["pre"]))["id"]
    assert got == want and len(want) > 100


@pytest.mark.parametrize("strict", [False, True])
def test_cull_against_brute_force(spark, nested_circles, strict):
    labelled, nodes = nested_circles
    rng = random.Random(6)
    views = [
        (i, rng.uniform(-1500, 1500), rng.uniform(-1500, 1500), math.exp(rng.uniform(-2, 4)), 1200.0, 800.0, rng.choice([None, 1, 2, 5]))
        for i in range(40)
    ]
    schema = "viewport_id int, cam_x double, cam_y double, k double, w double, h double, current_id bigint"
    seen = P.cull_viewports(labelled, spark.createDataFrame(views, schema), strict=strict)
    got = {(r["viewport_id"], r["id"]) for r in seen.select("viewport_id", "id").collect()}
    by_id = {n["id"]: n for n in nodes}
    want = set()
    for v, cx, cy, k, w, h, cur in views:
        x0, x1 = cx - w / 2 / k - 100 / k, cx + w / 2 / k + 100 / k
        y0, y1 = cy - h / 2 / k - 100 / k, cy + h / 2 / k + 100 / k
        start = by_id[cur] if cur else by_id[1]

        def visible(n):
            dx, dy = n["x"] - max(x0, min(n["x"], x1)), n["y"] - max(y0, min(n["y"], y1))
            return dx * dx + dy * dy <= n["r"] ** 2 and n["r"] * k >= 10

        for n in nodes:
            path = n["path_ids"]
            if start["id"] not in path:
                continue
            chain = path[path.index(start["id"]):] if strict else [n["id"]]
            if all(visible(by_id[a]) for a in chain):
                want.add((v, n["id"]))
    assert got == want and len(want) > 200


def test_place_labels(spark):
    schema = "viewport_id int, id bigint, turn int, x1 double, y1 double, x2 double, y2 double"
    rows = [
        (1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 2, 10.0, 0.0, 20.0, 10.0), (1, 3, 3, 11.0, 0.0, 20.0, 10.0),
        (1, 4, 4, 15.0, 5.0, 16.0, 6.0), (2, 2, 1, 10.0, 0.0, 20.0, 10.0),
    ]
    kept = P.place_labels(spark.createDataFrame(rows, schema)).select("viewport_id", "id").collect()
    # Touching counts as overlap; the third label is free once the second is rejected.
    assert sorted(map(tuple, kept)) == [(1, 1), (1, 3), (2, 2)]


def test_hover_at_x_zero(spark, nested_circles):
    labelled, _ = nested_circles
    hover = spark.createDataFrame(
        [(1, 1, 5.0, 5.0, 0.0, 0.0, 1.0, 1200.0, 800.0), (2, 901, 10.0, 10.0, 0.0, 0.0, 1.0, 1200.0, 800.0)],
        "hover_id int, id bigint, wx double, wy double, cam_x double, cam_y double, k double, w double, h double",
    )
    got = {r["hover_id"]: r["valid"] for r in P.revalidate_hover(labelled, hover).collect()}
    assert got == {1: True, 2: False}
