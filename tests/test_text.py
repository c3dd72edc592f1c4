import pytest
from pyspark.sql import functions as F

from ramify.functions import geometry as G
from ramify.functions import relevance as R
from ramify.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_"))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name,want",
    [
        ("homo sapiens", "Homo Sapiens"),
        ("darwin's frog (x)", "Darwin'S Frog (X)"),
        ("éclair b", "éClair B"),
        ("2nd a-b _c", "2nd A-B _c"),
        ("(homo x)", "(Homo X)"),
        ("", ""),
    ],
)
def test_titlecase(spark, name, want):
    assert one(spark, T.titlecase("n"), n=name) == want


@pytest.mark.parametrize(
    "name,want",
    [
        ("Homo sapiens", True), ("homo sapiens", False), ("Homo sapiens sapiens", True), ("Felis", True),
        ("FELIS", False), ("cat", False), ("Great White Shark", False), ("Red fox", True), ("Us", False),
        ("Homo sapiens var x", False), ("2nd form", True), ("McDonald", False), ("", False), (" Felis ", True),
    ],
)
def test_scientific_name(spark, name, want):
    assert one(spark, T.is_scientific_name("n"), n=name) is want


@pytest.mark.parametrize("source,want", [("gbif", True), ("protocol", False), ("ncbi:txid9", False), ("", True)])
def test_common_name(spark, source, want):
    assert one(spark, T.is_common_name("n", "s"), n="house cat", s=source) is want


@pytest.mark.parametrize("text,want", [("12abc", 12), (" -7 x", -7), ("+5", 5), ("x1", None), ("", None)])
def test_parse_int(spark, text, want):
    assert one(spark, T.parse_int("t"), t=text) == want


def test_uri(spark):
    assert one(spark, T.uri_component("t"), t="a b/(c)!'~*é+") == "a%20b%2F(c)!'~*%C3%A9%2B"
    assert one(spark, T.uri_decode("t"), t="%zz") == "%zz"
    assert one(spark, T.uri_decode("t"), t="a+b%20c") == "a+b c"
    assert one(spark, T.uri_decode(F.lit(None).cast("string"))) == ""
    assert one(spark, T.shard_key("p"), p=["Life", "a/b c"]) == "Life/a%252Fb%20c"
    assert one(spark, T.deep_link("p"), p=["Life", "a b"]) == "#Life%2Fa%20b"
    assert one(spark, T.deep_link(F.array().cast("array<string>"))) == ""


def test_cards(spark):
    assert one(spark, T.node_card("n", "l"), n=1_000_000, l=3) == "1,000,000 leaves • Level 3"
    assert one(spark, T.node_card("n", "l"), n=0, l=3) == "Level 3"
    assert one(spark, T.node_tooltip("n", "l"), n=12, l=3) == "Level: 3 • Descendants: 12"


@pytest.mark.parametrize(
    "text,q,want",
    [
        ("Red Fox", "fox", "Red <mark>Fox</mark>"),
        ("Red Fox", "rf", "<mark>R</mark>ed <mark>F</mark>ox"),
        ("Red Fox", "zz", "Red Fox"),
        ("Red Fox", "", "Red Fox"),
        ("abab", "ab", "<mark>ab</mark>ab"),
    ],
)
def test_highlight(spark, text, q, want):
    assert one(spark, T.highlight("t", q), t=text) == want


def score(name, q, children, level):
    """The scoring rule restated, for comparison."""
    low, q = name.lower(), q.lower()
    at = low.find(q)
    if low == q:
        s = 1000
    elif at == 0:
        s = 800 + max(0, 100 - len(name))
    elif at > 0:
        s = 400 + max(0, 50 - at) + max(0, 50 - len(name) / 2)
    else:
        hit = run = best = 0
        for c in low:
            if hit == len(q):
                break
            if c == q[hit]:
                hit, run = hit + 1, run + 1
                best = max(best, run)
            else:
                run = 0
        if hit < len(q):
            return 0
        s = 200 + best * 10 - max(0, len(name) - 2 * len(q))
    return s + (30 if children == 0 else 20 if children < 10 else 0) + (10 if 2 <= level <= 8 else 0)


@pytest.mark.parametrize("q", ["fox", "f.x", "red fox", "rx", "[a]", "x^", "RED"])
def test_relevance(spark, q):
    names = ["Fox", "Foxglove", "Red Fox", "red  fox", "f.x", "fax", "r-x " + "y" * 300, "[a]", "x^2", "zzz", "a]b[a"]
    cases = [(n, c, l) for n in names for c, l in ((0, 0), (5, 3), (50, 9))]
    df = spark.createDataFrame(cases, "name string, c int, level int")
    got = df.select("name", "c", "level", R.relevance(F.col("name"), q, F.col("c"), F.col("level")).alias("s")).collect()
    assert [r["s"] for r in got] == [score(n, q, c, l) for n, c, l in cases]


@pytest.mark.parametrize("value,want", [(-0.125, -0.12), (0.125, 0.13), (2.5, 2.5), (-1.0, -1.0)])
def test_round_half_up(spark, value, want):
    assert one(spark, G.round_half_up(F.col("v")), v=value) == want


def test_geometry(spark):
    assert one(spark, G.lod_class(F.col("r")), r=9.9) == "pruned"
    assert [one(spark, G.lod_class(F.col("r"), min_px=0.0), r=v) for v in (0.5, 1.5, 3.0, 6.0, 8.0)] == [
        "skip", "simple", "medium", "medium", "detail",
    ]
    assert one(spark, G.fit_zoom(F.col("r"), F.lit(1200.0), F.lit(800.0)), r=160.0) == 2.0
    assert one(spark, G.fit_zoom(F.col("r"), F.lit(1200.0), F.lit(800.0)), r=0.0) is None
    missing = F.lit(None).cast("double")
    assert one(spark, G.fit_zoom(missing, F.lit(1200.0), F.lit(800.0), 4000.0)) == 0.2
    assert one(spark, G.level_color(F.lit(38))) == G.BLUE_GRADIENT[0]
    assert one(spark, G.level_color(F.lit(None).cast("int"), "tableau10")) == G.TABLEAU10[0]
    assert [len(p) for p in G.PALETTES.values()] == [10, 38, 37]
