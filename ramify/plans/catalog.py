"""Every operator as a query over the star-schema tables, with its comparison SQL.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` maps the
same name to SQL over the tables. Queries without an entry there are checked by
invariants in the tests.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ramify.functions import geometry as G
from ramify.functions import relevance as R
from ramify.functions import text as T
from ramify.operators import cleaning as C
from ramify.operators import hierarchy as H
from ramify.operators import labels as L
from ramify.operators import layout as Y
from ramify.operators import search as S
from ramify.operators import spatial as P
from ramify.operators.ranking import mark_ends
from ramify.operators.shared_keys import join_shared
from ramify.plans import bake as B
from ramify.plans import oracles as O
from ramify.plans.views import labelled, laid_out_line, stored, table, view
from ramify.session import spread
from ramify.sources import nested as N
from ramify.sources import parts as A
from ramify.sources import taxonomy as X
from ramify.store import materialize, scratch_path
from ramify.streaming import telemetry as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its own name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def rounded(*names: str, digits: int = 6) -> list:
    return [F.round(n, digits).alias(n) for n in names]


# =============================================================================
# Hierarchy
# =============================================================================


@query(O.labelled_sql("geo", """
SELECT id, name, level, leaf_count, array_to_string(names, '/') AS path FROM lab WHERE level <= 2"""))
def leaf_counts_and_paths(spark, sf):
    """Leaf count and path of every node down to level 2."""
    top = labelled(spark, sf, "geo").filter("level <= 2")
    return L.node_path(top).select("id", "name", "level", "leaf_count", "path")


@query(O.labelled_sql("geo", "SELECT id, parent_id, name, level FROM walk"))
def build_hierarchy(spark, sf):
    return H.build_hierarchy(view(spark, sf, "geo"), paths=False).select("id", "parent_id", "name", "level")


@query(O.labelled_sql("geo", "SELECT id, level, array_to_string(ids, '/') AS path FROM lab"))
def build_hierarchy_paths(spark, sf):
    built = H.build_hierarchy(view(spark, sf, "geo"))
    return built.select("id", "level", F.array_join(F.col("path.id").cast("array<string>"), "/").alias("path"))


@query(O.labelled_sql("geo", "SELECT id, level, pre, pre_end, leaf_lo, leaf_count, subtree_size, child_count FROM lab"))
def label_without_paths(spark, sf):
    """All labels from sums, without any path."""
    found = L.label_hierarchy(view(spark, sf, "geo"), paths=False)
    return found.select("id", "level", "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count")


@query(O.labelled_sql("geo", "SELECT id, parent_id, level FROM walk WHERE level <= 2"))
def build_hierarchy_capped(spark, sf):
    return H.build_hierarchy(view(spark, sf, "geo"), max_depth=2).select("id", "parent_id", "level")


@query(O.view_sql("chain", """, walk AS (
  SELECT id, id AS root_id, 0 AS level FROM chain WHERE parent_id IS NULL
  UNION ALL SELECT c.id, w.root_id, w.level + 1 FROM chain c JOIN walk w ON c.parent_id = w.id
) SELECT id, root_id, level FROM walk"""))
def build_hierarchy_deep(spark, sf):
    """A forest of long chains: log2(depth) joins."""
    return H.build_hierarchy(view(spark, sf, "chain"), roots="many", paths=False).select("id", "root_id", "level")


@query(O.view_sql("geo", "SELECT id, name FROM geo WHERE parent_id IS NULL ORDER BY id LIMIT 1"))
def find_root(spark, sf):
    return H.find_root(view(spark, sf, "geo"))


@query(O.view_sql("geo", """
SELECT c.id, c.name, c.parent_id, p.name AS parent_name FROM geo c JOIN geo p ON p.id = c.parent_id"""))
def link_parents(spark, sf):
    return H.link_parents(view(spark, sf, "geo")).select("id", "name", "parent_id", "parent_name")


def _broken(spark, sf):
    """geo without every fifth nation: their customers have no parent row."""
    return view(spark, sf, "geo").filter("not (id between 100 and 124 and id % 5 = 0)")


_BROKEN = ", broken AS (SELECT * FROM geo WHERE NOT (id BETWEEN 100 AND 124 AND id % 5 = 0))"


@query(O.view_sql("geo", _BROKEN + """
SELECT id, parent_id, name FROM broken b
WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM broken p WHERE p.id = b.parent_id)"""))
def orphans(spark, sf):
    return H.orphans(_broken(spark, sf)).select("id", "parent_id", "name")


@query(O.view_sql("geo", _BROKEN + """, walk AS (
  SELECT id FROM broken WHERE parent_id IS NULL
  UNION ALL SELECT b.id FROM broken b JOIN walk w ON b.parent_id = w.id)
SELECT id, CASE WHEN parent_id IN (SELECT id FROM broken) THEN 'below a lost row or on a cycle' ELSE 'missing parent' END AS reason
FROM broken WHERE id NOT IN (SELECT id FROM walk)"""))
def unreached(spark, sf):
    rows = _broken(spark, sf)
    return H.unreached(rows, H.build_hierarchy(rows)).select("id", "reason")


@query(O.view_sql("geo", _BROKEN + """, walk AS (
  SELECT id FROM broken WHERE parent_id IS NULL
  UNION ALL SELECT b.id FROM broken b JOIN walk w ON b.parent_id = w.id)
SELECT 'rows' AS metric, count(*) AS value FROM broken
UNION ALL SELECT 'roots', count(*) FROM broken WHERE parent_id IS NULL
UNION ALL SELECT 'max_id', max(id) FROM broken
UNION ALL SELECT 'missing_parent', count(*) FROM broken WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM broken)
UNION ALL SELECT 'linked', count(*) FROM walk"""))
def rehydrate(spark, sf):
    return H.rehydrate(_broken(spark, sf))[1]


@query(O.view_sql("geo", """
SELECT id FROM geo WHERE id NOT IN (SELECT parent_id FROM geo WHERE parent_id IS NOT NULL)"""))
def leaf_ids(spark, sf):
    return H.leaf_ids(view(spark, sf, "geo"))


# --- labels ----------------------------------------------------------------------


@query(O.labelled_sql("geo", """
SELECT id, pre, pre_end, leaf_lo, leaf_count, subtree_size, child_count FROM lab"""))
def interval_labels(spark, sf):
    return labelled(spark, sf, "geo").select(
        "id", "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count"
    )


@query(O.labelled_sql("product", """
SELECT id, pre, pre_end, leaf_lo, leaf_count, subtree_size, child_count FROM lab"""))
def interval_labels_product(spark, sf):
    return labelled(spark, sf, "product").select(
        "id", "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count"
    )


@query(O.labelled_sql("talk", "SELECT id, level, array_to_string(names, ' > ') AS path FROM lab"))
def node_path(spark, sf):
    return L.node_path(labelled(spark, sf, "talk"), " > ").select("id", "level", "path")


@query(O.labelled_sql("geo", "SELECT id, name, leaf_count AS leaves FROM lab"))
def leaf_counts(spark, sf):
    return L.leaf_counts(labelled(spark, sf, "geo")).select("id", "name", "leaves")


@query(O.labelled_sql("geo", """, given AS (
  SELECT *, CASE WHEN level = 3 AND id % 4 = 0 THEN 7 WHEN level = 2 AND id % 9 = 0 THEN 100 ELSE 0 END AS preset FROM lab
), l4 AS (SELECT id, parent_id, 1 AS v FROM given WHERE level = 4),
l3 AS (SELECT g.id, g.parent_id, CASE WHEN preset <> 0 THEN preset ELSE greatest(1, (SELECT coalesce(sum(v), 0) FROM l4 WHERE l4.parent_id = g.id)) END AS v FROM given g WHERE level = 3),
l2 AS (SELECT g.id, g.parent_id, CASE WHEN preset <> 0 THEN preset ELSE greatest(1, (SELECT coalesce(sum(v), 0) FROM l3 WHERE l3.parent_id = g.id)) END AS v FROM given g WHERE level = 2),
l1 AS (SELECT g.id, g.parent_id, greatest(1, (SELECT coalesce(sum(v), 0) FROM l2 WHERE l2.parent_id = g.id)) AS v FROM given g WHERE level = 1),
l0 AS (SELECT g.id, g.parent_id, (SELECT sum(v) FROM l1) AS v FROM given g WHERE level = 0)
SELECT id, CAST(v AS BIGINT) AS leaves FROM
  (SELECT id, v FROM l0 UNION ALL SELECT id, v FROM l1 UNION ALL SELECT id, v FROM l2 UNION ALL SELECT id, v FROM l3 UNION ALL SELECT id, v FROM l4)"""))
def leaf_counts_preset(spark, sf):
    """Some nodes come with a count of their own, which their ancestors add up."""
    preset = F.when((F.col("level") == 3) & (F.col("id") % 4 == 0), 7).when(
        (F.col("level") == 2) & (F.col("id") % 9 == 0), 100
    ).otherwise(0)
    tree = L.label_hierarchy(view(spark, sf, "geo"), paths=False)
    return L.leaf_counts(tree.withColumn("preset", preset), "preset").select("id", "leaves")


@query(O.labelled_sql("geo", "SELECT name, subtree_size AS nodes FROM lab WHERE level <= 1"))
def count_nodes(spark, sf):
    return labelled(spark, sf, "geo").filter("level <= 1").select("name", F.col("subtree_size").alias("nodes"))


def _narrow(spark, sf):
    """geo labels without the paths: what a sort has to carry."""
    return labelled(spark, sf, "geo").drop("path_ids", "path_names")


@query(O.view_sql("geo", """
SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY name, id) AS ord FROM geo"""))
def sibling_order(spark, sf):
    return L.sibling_order(_narrow(spark, sf)).select("id", "parent_id", "ord")


@query(O.labelled_sql("geo", """, ranked AS (SELECT id, parent_id, level, row_number() OVER (ORDER BY level, k) AS bfs FROM lab)
SELECT a.id, a.bfs, b.bfs AS bfs_parent, a.level FROM ranked a LEFT JOIN ranked b ON b.id = a.parent_id"""))
def bfs_ids(spark, sf):
    return L.bfs_ids(_narrow(spark, sf)).select("id", "bfs", "bfs_parent", "level")


@query(O.labelled_sql("geo", "SELECT id, pre + 999 AS dfs, level + 1 AS level FROM lab"))
def dfs_ids(spark, sf):
    """Numbering that continues at 1000, below a parent at level 0."""
    return L.dfs_ids(labelled(spark, sf, "geo"), first_id=1000, start_level=1).select("id", "dfs", "level")


@query(O.labelled_sql("geo", "SELECT id, row_number() OVER (ORDER BY level DESC, k) AS pick_rank FROM lab"))
def pick_order(spark, sf):
    return L.pick_order(_narrow(spark, sf)).select("id", "pick_rank")


@query(O.labelled_sql("geo", """
SELECT a.id AS root_id, d.id, d.pre FROM lab a JOIN lab d ON d.pre BETWEEN a.pre AND a.pre_end WHERE a.level = 2"""))
def subtree(spark, sf):
    """The subtrees of all nations."""
    geo = labelled(spark, sf, "geo")
    return L.subtree(geo, geo.filter("level = 2").select("id")).select("root_id", "id", "pre")


@query(O.labelled_sql("geo", "SELECT d.id, d.pre FROM lab a JOIN lab d ON d.pre BETWEEN a.pre AND a.pre_end WHERE a.id = 12"))
def subtree_of_node(spark, sf):
    return L.subtree_of(labelled(spark, sf, "geo"), 12).select("id", "pre")


@query(O.labelled_sql("geo", "SELECT id, name, parent_id, subtree_size, leaf_count FROM lab WHERE level = 3"))
def focus(spark, sf):
    geo = labelled(spark, sf, "geo")
    return L.focus(geo, geo.filter("level = 3").select("id"))


@query(O.view_sql("geo", """
SELECT c.id AS from_id, p.id, p.name FROM geo c JOIN geo p ON p.id = c.parent_id WHERE c.id > 100000000"""))
def go_up(spark, sf):
    geo = labelled(spark, sf, "geo")
    return L.go_up(geo, geo.filter("id > 100000000").select("id")).select("from_id", "id", "name")


@query(ORACLES["go_up"])
def go_up_stored(spark, sf):
    geo = stored(spark, sf, "geo")
    return L.go_up(geo, geo.filter("id > 100000000").select("id")).select("from_id", "id", "name")


@query(ORACLES["focus"])
def focus_stored(spark, sf):
    geo = stored(spark, sf, "geo")
    return L.focus(geo, geo.filter("level = 3").select("id"))


def _pairs(spark, sf):
    """Every order against the nation with its key, modulo 26; 25 stands for none."""
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (o + 100000000).alias("node_id"), F.when(o % 26 < 25, 100 + o % 26).alias("current_id")
    )


@query(O.labelled_sql("geo", """, pairs AS (
  SELECT 100000000 + o_orderkey AS node_id, CASE WHEN o_orderkey % 26 < 25 THEN 100 + o_orderkey % 26 END AS current_id FROM orders)
SELECT p.node_id, p.current_id, p.current_id IS NULL OR list_contains(l.ids, p.current_id) AS inside
FROM pairs p JOIN lab l ON l.id = p.node_id"""))
def is_in_subtree(spark, sf):
    return L.is_in_subtree(labelled(spark, sf, "geo"), _pairs(spark, sf)).select("node_id", "current_id", "inside")


@query(ORACLES["is_in_subtree"])
def is_in_subtree_stored(spark, sf):
    return L.is_in_subtree(stored(spark, sf, "geo"), _pairs(spark, sf)).select("node_id", "current_id", "inside")


@query(O.labelled_sql("geo", """, exploded AS (SELECT unnest(ids) AS a, level, child_count, leaf_count FROM lab)
SELECT a AS id, CAST(sum(CASE WHEN child_count = 0 THEN 1 ELSE 0 END) AS BIGINT) AS leaf_value, count(*) AS node_value,
  CAST(sum(leaf_count) AS BIGINT) AS leaf_count_value,
  round(sum(CASE WHEN child_count = 0 THEN power(0.9::DOUBLE, level) ELSE 0 END), 6) AS weighted
FROM exploded GROUP BY a"""))
def rollup_value(spark, sf):
    """The four node values, each rolled up."""
    geo = labelled(spark, sf, "geo")
    names = {"leaf": "leaf_value", "node": "node_value", "leaf_count": "leaf_count_value", "depth_weighted": "weighted"}
    out = L.rollup_values(geo, {name: L.node_value(preset) for preset, name in names.items()})
    return out.withColumn("weighted", F.round("weighted", 6))


@query(O.view_sql("geo", "SELECT parent_id, count(*) AS child_count FROM geo WHERE parent_id IS NOT NULL GROUP BY parent_id"))
def family_stats(spark, sf):
    return L.family_stats(view(spark, sf, "geo"))


@query(O.labelled_sql("geo", """
SELECT id, CAST(sum(leaf_count) OVER (PARTITION BY parent_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS leaves_upto
FROM lab WHERE parent_id IS NOT NULL"""))
def family_leaf_offsets(spark, sf):
    return L.family_leaf_offsets(labelled(spark, sf, "geo")).select("id", "leaves_upto")


@query(O.labelled_sql("geo", """, asked AS (
  SELECT event_id, 10 + user_id % 5 AS id, (event_id % 1000) / 1000.0::DOUBLE AS u FROM events
), target AS (
  SELECT a.event_id, l.leaf_lo + CAST(floor(a.u * l.leaf_count) AS BIGINT) AS leaf FROM asked a JOIN lab l ON l.id = a.id)
SELECT t.event_id, l.id AS leaf_id, l.name AS leaf_name FROM target t JOIN lab l ON l.leaf_lo = t.leaf AND l.child_count = 0"""))
def random_leaf(spark, sf):
    asked = table(spark, sf, "events").select(
        "event_id", (10 + F.col("user_id") % 5).alias("id"), ((F.col("event_id") % 1000) / 1000.0).alias("u")
    )
    return L.random_leaf(labelled(spark, sf, "geo"), asked).select("event_id", "leaf_id", "leaf_name")


_STRATEGIES = {
    "value_desc": "value DESC, k",
    "value_asc": "value, k",
    "name": "name, id",
    "depth_asc": "level, k",
    "depth_desc": "level DESC, k",
    "leaves_desc": "leaf_count DESC, k",
    "children_desc": "child_count DESC, k",
    "value_then_name": "value DESC, name, id",
    "hybrid": "value DESC, level, k",
    "rank": "CASE rank WHEN 'species' THEN 1 WHEN 'genus' THEN 2 WHEN 'family' THEN 3 WHEN 'order' THEN 4 ELSE 99 END, k",
}


@query(O.labelled_sql("geo", """, valued AS (
  SELECT *, leaf_count AS value, CASE level WHEN 4 THEN CASE id % 3 WHEN 0 THEN 'species' WHEN 1 THEN 'genus' ELSE 'clade' END
    WHEN 3 THEN CASE id % 2 WHEN 0 THEN 'family' ELSE 'order' END ELSE 'no rank' END AS rank FROM lab)
""" + " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, id, row_number() OVER (PARTITION BY parent_id ORDER BY {o}) AS ord FROM valued"
    for s, o in _STRATEGIES.items()
)))
def order_siblings(spark, sf):
    """Each named sibling order, over the whole tree."""
    rank = (
        F.when(F.col("level") == 4, F.element_at(F.array(*map(F.lit, ["species", "genus", "clade"])), (F.col("id") % 3 + 1).cast("int")))
        .when(F.col("level") == 3, F.when(F.col("id") % 2 == 0, "family").otherwise("order"))
        .otherwise("no rank")
    )
    # What the sorts of the strategies have to carry.
    geo = labelled(spark, sf, "geo").select("id", "parent_id", "name", "level", "pre", "leaf_count", "child_count")
    geo = geo.withColumn("value", F.col("leaf_count")).withColumn("rank", rank)
    return union(*[
        L.order_siblings(geo, s).select(F.lit(s).alias("strategy"), "id", "ord") for s in _STRATEGIES
    ])


@query(O.view_sql("geo", """
SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY md5(id || ':7'), id) AS ord FROM geo"""))
def order_siblings_random(spark, sf):
    """Reproducible shuffle of every family."""
    return L.order_siblings(_narrow(spark, sf), "random", seed=7).select("id", "parent_id", "ord")


@query(O.view_sql("geo", """
SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY length(name) DESC, name, id) AS ord FROM geo"""))
def order_siblings_own_keys(spark, sf):
    """Sort keys of the caller."""
    keys = [F.length("name").desc(), F.col("name"), F.col("id")]
    return L.order_siblings(_narrow(spark, sf), keys).select("id", "parent_id", "ord")


@query(O.labelled_sql("geo_full", "SELECT id, level, pre, pre_end, leaf_lo, leaf_count, subtree_size, child_count FROM lab"))
def interval_labels_full(spark, sf):
    """The hierarchy down to the line items."""
    found = L.label_hierarchy(view(spark, sf, "geo_full"), paths=False)
    return found.select("id", "level", "pre", "pre_end", "leaf_lo", "leaf_count", "subtree_size", "child_count")


# =============================================================================
# Names and cleaning
# =============================================================================


@query(O.view_sql("product", "SELECT id, lower(name) AS name FROM product"))
def lowercase_names(spark, sf):
    return C.lowercase_names(view(spark, sf, "product")).select("id", "name")


@query("""
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1:1]) || w[2:] ELSE w END), '') AS name FROM documents""")
def titlecase_names(spark, sf):
    """Whole document texts: four languages, accents and apostrophes."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", F.col("text").alias("name"))
    return C.titlecase_names(docs)


@query("SELECT doc_id AS id, substr(text, 1, 100) AS name FROM documents")
def truncate_names(spark, sf):
    docs = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("id"), F.col("text").alias("name"))
    return C.truncate_names(docs, 100)


@query(O.view_sql("geo", """
SELECT id, CASE WHEN id % 3 = 0 OR trim(name) = '' THEN concat('Unknown_', CAST(id AS STRING)) ELSE name END AS name FROM geo"""))
def default_names(spark, sf):
    holes = view(spark, sf, "geo").withColumn("name", F.when(F.col("id") % 3 != 0, F.col("name")))
    return C.default_names(holes).select("id", "name")


@query(O.labelled_sql("geo", "SELECT id, parent_id, name, level, leaf_count FROM lab"))
def keep_essential(spark, sf):
    return C.keep_essential(labelled(spark, sf, "geo"))


@query("""
SELECT page_id, regexp_matches(url, 'page=[0-9]+') AS kept,
  CAST(coalesce(nullif(regexp_extract(url, '^[^0-9]*([0-9]+)', 1), ''), '-1') AS BIGINT) AS number FROM pages""")
def valid_rows(spark, sf):
    """Kept and quarantined rows, with the leading number of the URL parsed."""
    number = T.parse_int(F.regexp_replace("url", r"^[^0-9]*", ""))
    pages = table(spark, sf, "pages").withColumn("number", F.coalesce(number, F.lit(-1)))
    kept, quarantined = C.split_valid(pages, F.col("url").rlike("page=[0-9]+"))
    return union(kept.withColumn("kept", F.lit(True)), quarantined.withColumn("kept", F.lit(False))).select(
        "page_id", "kept", "number"
    )


_SCI = r"""CASE
  WHEN len(w) = 1 THEN w[1] <> lower(w[1]) AND w[1] <> upper(w[1]) AND regexp_matches(w[1], '(?i)^[a-z][a-z]+(us|um|a|is|es|ae|i|ii|iii)$')
  WHEN len(w) IN (2, 3) THEN w[1][1:1] = upper(w[1][1:1]) AND w[1][2:] = lower(w[1][2:]) AND w[2] = lower(w[2]) AND (len(w) = 2 OR w[3] = lower(w[3]))
  ELSE false END"""
# All names of the star schema; a part's in the case of its key, so that all forms of names occur.
_NAMES = """names AS (
  SELECT 'part' AS kind, p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name[1:1]) || p_name[2:] ELSE p_type END AS name FROM part
  UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier
), split AS (SELECT *, string_split_regex(name, '\\s+') AS w FROM names)"""


def _all_names(spark, sf):
    part = table(spark, sf, "part")
    key, name = F.col("p_partkey"), F.col("p_name")
    raised = F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))
    return union(
        part.select(F.lit("part").alias("kind"), key.alias("key"), F.when(key % 3 == 0, name).when(key % 3 == 1, raised).otherwise(F.col("p_type")).alias("name")),
        table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")),
        table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
    )


@query(f"WITH {_NAMES} SELECT kind, key, name, {_SCI} AS scientific FROM split")
def is_scientific_name(spark, sf):
    return _all_names(spark, sf).select("kind", "key", "name", T.is_scientific_name("name").alias("scientific"))


_LISTED = " OR ".join(f"contains(upper(source), '{s.upper()}')" for s in T.SCIENTIFIC_SOURCES)


@query(f"""WITH {_NAMES}, sourced AS (
  SELECT kind, key, name, w, CASE key % 4 WHEN 0 THEN 'protocol 7' WHEN 1 THEN 'gbif' WHEN 2 THEN 'Ncbi:txid' ELSE kind END AS source FROM split)
SELECT kind, key, name, length(name) > 0 AND NOT ({_LISTED}) AND NOT ({_SCI}) AS common FROM sourced""")
def is_common_name(spark, sf):
    source = F.element_at(
        F.array(F.lit("protocol 7"), F.lit("gbif"), F.lit("Ncbi:txid"), F.col("kind")), (F.col("key") % 4 + 1).cast("int")
    )
    named = _all_names(spark, sf).withColumn("source", source)
    return named.select("kind", "key", "name", T.is_common_name("name", "source").alias("common"))


# Synonyms capitalised for some lines, so that a part of them looks scientific.
_SYN = O.view_ctes("synonyms") + """, syn AS (
  SELECT line_no, CASE WHEN line_no % 3 = 0 THEN upper(synonym[1:1]) || synonym[2:] ELSE synonym END AS synonym, ott_id, source FROM synonyms
), best AS (
  SELECT ott_id, synonym AS common_name FROM (
    SELECT *, row_number() OVER (PARTITION BY ott_id ORDER BY length(synonym), line_no) AS rn FROM (
      SELECT *, string_split(synonym, ' ') AS w FROM syn) WHERE NOT (""" + _SCI + """)) WHERE rn = 1)"""


def _synonyms(spark, sf):
    s = F.col("synonym")
    raised = F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    return view(spark, sf, "synonyms").withColumn("synonym", F.when(F.col("line_no") % 3 == 0, raised).otherwise(s))


@query(f"WITH {_SYN} SELECT ott_id, common_name FROM best")
def best_common_name(spark, sf):
    return C.best_common_name(_synonyms(spark, sf))


@query(f"WITH {O.view_ctes('geo')}, {_SYN} SELECT id, CASE WHEN common_name IS NULL THEN name ELSE common_name || ' (' || name || ')' END AS name FROM geo LEFT JOIN best ON ott_id = id")
def apply_common_names(spark, sf):
    named = C.apply_common_names(view(spark, sf, "geo"), C.best_common_name(_synonyms(spark, sf)))
    return named.select("id", "name")


@query(f"""WITH {O.view_ctes('geo')}, {_SYN}
SELECT 'common_names' AS metric, count(*) AS value FROM best
UNION ALL SELECT 'matched', count(*) FROM best WHERE ott_id IN (SELECT id FROM geo)
UNION ALL SELECT 'tree_nodes', count(DISTINCT id) FROM geo""")
def common_name_coverage(spark, sf):
    return C.common_name_coverage(view(spark, sf, "geo"), C.best_common_name(_synonyms(spark, sf)))


@query(f"WITH {O.view_ctes('geo', 'synonyms')} SELECT id FROM geo INTERSECT SELECT ott_id FROM synonyms")
def tree_ids_with_synonyms(spark, sf):
    return C.tree_ids_with_synonyms(view(spark, sf, "geo"), view(spark, sf, "synonyms"))


@query(f"WITH {O.view_ctes('geo')}, {_SYN} SELECT count(*) AS with_common_name FROM geo JOIN best ON ott_id = id")
def count_with_common_name(spark, sf):
    named = C.apply_common_names(view(spark, sf, "geo"), C.best_common_name(_synonyms(spark, sf)))
    return C.count_with_common_name(named)


_DUP = O.view_sql("product", """, leaves AS (
  SELECT * FROM product WHERE id NOT IN (SELECT parent_id FROM product WHERE parent_id IS NOT NULL) AND trim(name) <> ''
), copies AS (SELECT lower(name) AS n, count(*) AS c FROM leaves GROUP BY 1)
""")


@query(_DUP + "SELECT id, parent_id, name FROM product WHERE id NOT IN (SELECT l.id FROM leaves l JOIN copies ON n = lower(name) WHERE c > 1)")
def drop_duplicate_leaves(spark, sf):
    return C.drop_duplicate_leaves(view(spark, sf, "product"))


@query(_DUP + "SELECT n AS leaf_name, c AS copies FROM copies")
def duplicate_name_counts(spark, sf):
    return C.duplicate_name_counts(labelled(spark, sf, "product"))


@query(O.view_sql("geo_ph", """
SELECT k.id, CASE WHEN p.name = 'sibling_higher' THEN p.parent_id ELSE k.parent_id END AS parent_id, k.name
FROM geo_ph k LEFT JOIN geo_ph p ON p.id = k.parent_id WHERE k.name <> 'sibling_higher'"""))
def drop_placeholder_flat(spark, sf):
    return C.drop_placeholder_flat(view(spark, sf, "geo_ph")).select("id", "parent_id", "name")


# Chains of placeholders: every fifth nation and every third of their customers.
_DEEP_PH = """, deep AS (SELECT id, parent_id, CASE WHEN id BETWEEN 1000000 AND 99999999 AND id % 3 = 0 THEN 'sibling_higher' ELSE name END AS name FROM geo_ph)"""


@query(O.view_sql("geo_ph", _DEEP_PH + """, lifted AS (
  SELECT id, name, parent_id FROM deep WHERE name <> 'sibling_higher'
  UNION ALL SELECT l.id, l.name, d.parent_id FROM lifted l JOIN deep d ON d.id = l.parent_id WHERE d.name = 'sibling_higher')
SELECT id, name, parent_id FROM lifted l WHERE parent_id IS NULL OR EXISTS (SELECT 1 FROM deep d WHERE d.id = l.parent_id AND d.name <> 'sibling_higher')"""))
def drop_placeholder_deep(spark, sf):
    name = F.when(F.col("id").between(1000000, 99999999) & (F.col("id") % 3 == 0), C.PLACEHOLDER).otherwise(F.col("name"))
    deep = view(spark, sf, "geo_ph").withColumn("name", name)
    return C.drop_placeholder_deep(deep).select("id", "name", "parent_id")


@query(f"""WITH {O.view_ctes('geo_ph')}, {_SYN}, named AS (
  SELECT id, parent_id, CASE WHEN common_name IS NULL THEN name ELSE common_name || ' (' || name || ')' END AS name, common_name IS NOT NULL AS renamed
  FROM geo_ph LEFT JOIN best ON ott_id = id
), leaves AS (
  SELECT * FROM named WHERE parent_id IS NOT NULL AND id NOT IN (SELECT parent_id FROM named WHERE parent_id IS NOT NULL) AND trim(name) <> ''
), twice AS (SELECT lower(name) AS n FROM leaves GROUP BY 1 HAVING count(*) > 1
), single AS (SELECT * FROM named WHERE id NOT IN (SELECT id FROM leaves WHERE lower(name) IN (SELECT n FROM twice))
), marks AS (SELECT * FROM single WHERE name = 'sibling_higher' AND parent_id IS NOT NULL
), spliced AS (
  SELECT s.id, s.name, m.id IS NOT NULL AS moved FROM single s LEFT JOIN marks m ON m.id = s.parent_id WHERE s.id NOT IN (SELECT id FROM marks))
SELECT 'renamed' AS step, count(*) AS changed FROM named WHERE renamed
UNION ALL SELECT 'duplicate leaves removed', (SELECT count(*) FROM named) - (SELECT count(*) FROM single)
UNION ALL SELECT 'placeholders removed', count(*) FROM marks
UNION ALL SELECT 're-parented', count(*) FROM spliced WHERE moved
UNION ALL SELECT 'lowercased', count(*) FROM spliced WHERE lower(name) <> name
UNION ALL SELECT 'capitalised', count(*) FROM spliced WHERE regexp_matches(lower(name), '(^|[^A-Za-z0-9_])[a-z]')""")
def cleaning_report(spark, sf):
    """Counts of the steps as they follow each other."""
    return C.cleaning_report(view(spark, sf, "geo_ph"), C.best_common_name(_synonyms(spark, sf)))


# =============================================================================
# Search, paths, text
# =============================================================================

TERMS = ["widget", "nation_1", "afr", "ctm12", "order#12", "Life", "  "]


@query(O.labelled_sql("geo", "," + O.score_ctes(TERMS) + """, ranked AS (
  SELECT query, id, name, base + bonus AS score, row_number() OVER (PARTITION BY query ORDER BY base + bonus DESC, name, id) AS rank FROM scored)
SELECT query, rank, id, name, score FROM ranked"""))
def search(spark, sf):
    return S.search(labelled(spark, sf, "geo"), TERMS).drop("path_names")


@query(O.labelled_sql("product", "," + O.score_ctes(["ring", "small ring 12", "brand#1", "sng", "parts"]) + """, ranked AS (
  SELECT query, id, name, base + bonus AS score, row_number() OVER (PARTITION BY query ORDER BY base + bonus DESC, name, id) AS rank FROM scored)
SELECT query, rank, id, name, score FROM ranked WHERE rank <= 20"""))
def search_product(spark, sf):
    terms = ["ring", "small ring 12", "brand#1", "sng", "parts"]
    return S.search(labelled(spark, sf, "product"), terms, limit=20).drop("path_names")


_PART_TERMS = "SELECT DISTINCT split_part(p_name, ' ', 1) || ' ' || CAST(p_size AS VARCHAR) AS query FROM part"


@query(O.labelled_sql("product", "," + O.score_ctes(_PART_TERMS) + """, ranked AS (
  SELECT query, id, name, base + bonus AS score, row_number() OVER (PARTITION BY query ORDER BY base + bonus DESC, name, id) AS rank FROM scored)
SELECT query, rank, id, name, score FROM ranked"""))
def search_terms(spark, sf):
    """A table of queries, one per part: its first word and its size, which stand apart in names."""
    word = F.element_at(F.split("p_name", " "), 1)
    asked = table(spark, sf, "part").select(F.concat_ws(" ", word, F.col("p_size").cast("string")).alias("query"))
    return S.search_terms(labelled(spark, sf, "product"), asked)


@query(O.labelled_sql("geo", "," + O.score_ctes(TERMS) + """, seen AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY level - pre_end) AS s FROM scored
), first AS (
  SELECT *, sum(CASE WHEN base >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS exact,
    sum(CASE WHEN base < 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY s) AS turn FROM seen WHERE s <= 60
), final AS (
  SELECT query, id, name, CASE WHEN base >= 1000 OR turn > 40 THEN base ELSE base + bonus END AS score
  FROM first WHERE base >= 1000 OR exact < 20
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name, id) AS rank FROM final)
SELECT query, CAST(rank AS INTEGER) AS rank, id, name, score FROM ranked WHERE rank <= 20"""))
def search_first_candidates(spark, sf):
    return S.search_first_candidates(labelled(spark, sf, "geo"), TERMS, limit=20, candidates=60)


@query(O.labelled_sql("geo", "," + O.score_ctes(TERMS) + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY base + bonus DESC, name, id) AS rank FROM scored)
SELECT query, rank, id, name, array_to_string(names[1:len(names) - 1], ' / ') AS path FROM ranked"""))
def search_results(spark, sf):
    return S.search_results(S.search(labelled(spark, sf, "geo"), TERMS))


@query(O.labelled_sql("geo", f"""SELECT id, length('cst12') = f.hit AS fuzzy, CASE WHEN length('cst12') = f.hit THEN f.best END AS run
FROM (SELECT id, {O.fuzzy_fold("name", "'cst12'")} AS f FROM lab)"""))
def is_subsequence(spark, sf):
    name = F.col("name")
    hit = R.is_subsequence(name, "cst12")
    return labelled(spark, sf, "geo").select("id", hit.alias("fuzzy"), F.when(hit, R.longest_run(name, "cst12")).alias("run"))


@query(r"""SELECT doc_id, CASE WHEN strpos(lower(text), 'the') > 0
  THEN text[1:strpos(lower(text), 'the') - 1] || '<mark>' || substr(text, strpos(lower(text), 'the'), 3) || '</mark>' || substr(text, strpos(lower(text), 'the') + 3)
  WHEN regexp_matches(text, '(?is)^[^t]*t[^h]*h[^e]*e')
  THEN regexp_replace(text, '(?is)^([^t]*)(t)([^h]*)(h)([^e]*)(e)', '\1<mark>\2</mark>\3<mark>\4</mark>\5<mark>\6</mark>')
  ELSE text END AS marked FROM documents""")
def highlight(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", T.highlight("text", "the").alias("marked"))


def _path_requests(spark, sf):
    """For every nation: a full path, one without the root, one that fails half-way; and an empty one."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    return union(
        n.select((key * 4).alias("path_no"), F.concat(F.lit("Life/"), "r_name", F.lit("/"), "n_name").alias("path")),
        n.select((key * 4 + 1).alias("path_no"), F.concat("r_name", F.lit("//"), "n_name").alias("path")),
        n.select((key * 4 + 2).alias("path_no"), F.concat(F.lit("Life/"), "r_name", F.lit("/NOPE/x")).alias("path")),
        n.select((key * 4 + 3).alias("path_no"), F.lit("").alias("path")),
    )


@query("""
SELECT n_nationkey * 4 AS path_no, CAST(100 + n_nationkey AS BIGINT) AS id, n_name AS name, 2 AS matched FROM nation
UNION ALL SELECT n_nationkey * 4 + 1, 100 + n_nationkey, n_name, 2 FROM nation
UNION ALL SELECT n_nationkey * 4 + 2, 10 + n_regionkey, r_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT n_nationkey * 4 + 3, 1, 'Life', 0 FROM nation""")
def resolve_path(spark, sf):
    """On a table labelled without paths."""
    return S.resolve_paths(L.label_hierarchy(view(spark, sf, "geo"), paths=False), _path_requests(spark, sf))


# Same names under one parent: brands and part names, the first of equal names counts.
@query(O.view_sql("product", """, asked AS (
  SELECT p_partkey AS path_no, 100 + CAST(substr(p_brand, 7) AS BIGINT) AS brand, concat(p_name, ' ', CAST(p_size AS STRING)) AS leaf FROM part)
SELECT path_no, min(p.id) AS id FROM asked JOIN product p ON p.parent_id = brand AND p.name = leaf GROUP BY path_no"""))
def resolve_path_repeated_names(spark, sf):
    asked = table(spark, sf, "part").select(
        F.col("p_partkey").alias("path_no"),
        F.concat_ws("/", F.lit("Parts"), "p_brand", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("path"),
    )
    return S.resolve_paths(labelled(spark, sf, "product"), asked).select("path_no", "id")


@query(O.labelled_sql("geo", f"SELECT id, '#' || {O.uri('array_to_string(names, chr(47))')} AS link FROM lab"))
def deep_link(spark, sf):
    return labelled(spark, sf, "geo").select("id", T.deep_link("path_names").alias("link"))


@query(O.labelled_sql("geo", f"SELECT id, array_to_string(list_transform(names, lambda n: {O.uri('n')}), '/') AS shard_key FROM lab"))
def shard_key(spark, sf):
    return labelled(spark, sf, "geo").select("id", T.shard_key("path_names").alias("shard_key"))


@query(f"SELECT doc_id, {O.uri('text')} AS encoded, text AS decoded FROM documents")
def uri_component(spark, sf):
    """Whole texts encoded and decoded again."""
    coded = spread(table(spark, sf, "documents")).select("doc_id", T.uri_component("text").alias("encoded"))
    return coded.withColumn("decoded", T.uri_decode("encoded"))


@query(O.view_sql("product", "SELECT id, base || " + O.uri("name") + """ AS url FROM (SELECT id, name, CASE id % 7
  WHEN 0 THEN 'https://www.google.com/search?q=' WHEN 1 THEN 'https://en.wikipedia.org/wiki/Special:Search?search='
  WHEN 2 THEN 'https://www.gbif.org/species/search?q=' WHEN 3 THEN 'https://www.ncbi.nlm.nih.gov/taxonomy/?term='
  WHEN 4 THEN 'https://www.catalogueoflife.org/data/search?q=' WHEN 5 THEN 'https://www.inaturalist.org/search?q='
  ELSE 'https://www.google.com/search?q=' END AS base FROM product)"""))
def provider_url(spark, sf):
    providers = F.array(*[F.lit(p) for p in ["google", "wikipedia", "gbif", "ncbi", "col", "inat", "other"]])
    chosen = F.element_at(providers, (F.col("id") % 7 + 1).cast("int"))
    return view(spark, sf, "product").select("id", T.provider_url(chosen, "name").alias("url"))


@query(O.labelled_sql("geo", """
SELECT id, format('{:,}', leaf_count) || ' leaves • Level ' || level AS card,
  'Level: ' || level || ' • Descendants: ' || format('{:,}', leaf_count) AS tip FROM lab"""))
def node_card(spark, sf):
    return labelled(spark, sf, "geo").select(
        "id", T.node_card("leaf_count", "level").alias("card"), T.node_tooltip("leaf_count", "level").alias("tip")
    )


@query(O.view_sql("product", """, raw AS (
  SELECT upper(concat(p_name, ' ', CAST(p_size AS STRING))) AS title, 'Q' || (p_partkey % 50) AS item,
    CASE p_partkey % 3 WHEN 0 THEN 'HTTPS://img.example/' || p_partkey WHEN 1 THEN 'ftp://img.example/x' END AS thumb, p_type AS extract FROM part
), page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(title) ORDER BY title, item, thumb NULLS FIRST, extract) AS rn FROM raw) WHERE rn = 1
), ranks AS (SELECT 'Q' || (p_partkey % 40) AS item, min(p_brand) AS label FROM part GROUP BY 1)
SELECT id, CASE WHEN regexp_matches(thumb, '(?i)^https?://') THEN thumb END AS thumbnail, extract,
  CASE WHEN label IS NULL THEN name ELSE name || ' (' || label || ')' END AS caption
FROM product LEFT JOIN page ON lower(name) = lower(title) LEFT JOIN ranks ON ranks.item = page.item"""))
def enrich_nodes(spark, sf):
    part = table(spark, sf, "part")
    key = F.col("p_partkey")
    pages = part.select(
        F.upper(F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).alias("title"),
        F.when(key % 3 == 0, F.concat(F.lit("HTTPS://img.example/"), key.cast("string"))).when(key % 3 == 1, "ftp://img.example/x").alias("thumbnail"),
        F.col("p_type").alias("extract"),
        F.concat(F.lit("Q"), (key % 50).cast("string")).alias("wikibase_item"),
    )
    ranks = part.select(F.concat(F.lit("Q"), (key % 40).cast("string")).alias("wikibase_item"), F.col("p_brand").alias("rank_label"))
    return S.enrich_nodes(view(spark, sf, "product"), pages, ranks).select("id", "thumbnail", "extract", "caption")


# =============================================================================
# Spatial
# =============================================================================


def _viewports(spark, sf):
    """One per nation of geo_line, fitted to it."""
    nation = laid_out_line(spark, sf).filter("level = 2")
    w, h = F.lit(1200.0), F.lit(800.0)
    return nation.select(
        F.col("id").alias("viewport_id"), F.col("x").alias("cam_x"), F.col("y").alias("cam_y"),
        G.fit_zoom(F.col("r"), w, h).alias("k"), w.alias("w"), h.alias("h"),
    )


_VIEWPORTS = """, viewports AS (
  SELECT id AS viewport_id, x AS cam_x, y AS cam_y, 800.0::DOUBLE * 0.4::DOUBLE / r AS k, 1200.0::DOUBLE AS w, 800.0::DOUBLE AS h FROM geo_line WHERE level = 2)"""
_RECT = """, rects AS (SELECT *, cam_x - (w / (2 * k) + 100 / k) AS x0, cam_x + (w / (2 * k) + 100 / k) AS x1,
  cam_y - (h / (2 * k) + 100 / k) AS y0, cam_y + (h / (2 * k) + 100 / k) AS y1 FROM viewports)"""
_VISIBLE = _VIEWPORTS + _RECT + """, visible AS (
  SELECT v.*, n.*, n.r * v.k AS sr FROM rects v JOIN geo_line n
    ON n.r * v.k >= 10 AND n.x + n.r >= x0 AND n.x - n.r <= x1 AND n.y + n.r >= y0 AND n.y - n.r <= y1
    AND (n.x - greatest(x0, least(n.x, x1))) * (n.x - greatest(x0, least(n.x, x1)))
      + (n.y - greatest(y0, least(n.y, y1))) * (n.y - greatest(y0, least(n.y, y1))) <= n.r * n.r)"""


def _visible(spark, sf):
    return P.cull_viewports(laid_out_line(spark, sf), _viewports(spark, sf))


@query(O.line_sql(_VISIBLE + " SELECT viewport_id, id, round(sr, 6) AS sr FROM visible"))
def cull_viewports(spark, sf):
    return _visible(spark, sf).select("viewport_id", "id", *rounded("sr"))


@query(O.line_sql(_VISIBLE + """, inside AS (
  SELECT a.viewport_id, a.id FROM visible a JOIN lab l ON l.id = a.id WHERE list_contains(l.ids, a.viewport_id)
), bad AS (SELECT b.viewport_id, b.id FROM inside b JOIN lab l ON l.id = b.id, unnest(l.ids) AS u(anc)
  WHERE list_position(l.ids, anc) >= list_position(l.ids, b.viewport_id) AND NOT EXISTS (
    SELECT 1 FROM inside v WHERE v.viewport_id = b.viewport_id AND v.id = anc))
SELECT viewport_id, id FROM inside EXCEPT SELECT viewport_id, id FROM bad""", labels=True))
def cull_viewports_below_current(spark, sf):
    """Each viewport draws only the subtree of its nation, ancestors checked."""
    current = _viewports(spark, sf).withColumn("current_id", F.col("viewport_id"))
    return P.cull_viewports(laid_out_line(spark, sf), current, strict=True).select("viewport_id", "id")


@query(O.line_sql(_VISIBLE + """, ranked AS (
  SELECT v.viewport_id, v.id, row_number() OVER (PARTITION BY v.viewport_id ORDER BY l.pre) AS drawn FROM visible v JOIN lab l ON l.id = v.id)
SELECT viewport_id, id, drawn FROM ranked""", labels=True))
def node_budget(spark, sf):
    """Every visible node with its number."""
    return P.node_budget(_visible(spark, sf)).select("viewport_id", "id", "drawn")


@query(O.line_sql(_VISIBLE + """, ranked AS (
  SELECT v.viewport_id, v.id, row_number() OVER (PARTITION BY v.viewport_id ORDER BY l.pre) AS drawn FROM visible v JOIN lab l ON l.id = v.id)
SELECT viewport_id, id, CAST(drawn AS INTEGER) AS drawn FROM ranked WHERE drawn <= 40""", labels=True))
def node_budget_limited(spark, sf):
    """The first 40 of each viewport."""
    return P.node_budget(_visible(spark, sf), 40).select("viewport_id", "id", "drawn")


@query(O.line_sql("""SELECT n.id, round(least(c.top, n.y + n.r) - (n.y - n.r), 6) AS space FROM geo_line n
JOIN (SELECT parent_id, min(y - r) AS top FROM geo_line WHERE parent_id IS NOT NULL GROUP BY 1) c ON c.parent_id = n.id
UNION ALL SELECT id, round(2 * r, 6) FROM geo_line WHERE id NOT IN (SELECT parent_id FROM geo_line WHERE parent_id IS NOT NULL)"""))
def label_space(spark, sf):
    return P.label_space(laid_out_line(spark, sf)).select("id", *rounded("space"))


_LABELS = _VISIBLE + """, space AS (
  SELECT n.id, coalesce(least(c.top, n.y + n.r) - (n.y - n.r), 2 * n.r) AS space FROM geo_line n
  LEFT JOIN (SELECT parent_id, min(y - r) AS top FROM geo_line WHERE parent_id IS NOT NULL GROUP BY 1) c ON c.parent_id = n.id
), sized AS (
  SELECT v.*, s.space * v.k AS room, least(18.0::DOUBLE, greatest(10.0::DOUBLE, sr / 3)) AS font, l.pre
  FROM visible v JOIN space s ON s.id = v.id JOIN lab l ON l.id = v.id WHERE sr > 22
), tried AS (
  SELECT *, w / 2 + (x - cam_x) * k AS sx, h / 2 + (y - cam_y) * k - sr + room / 2 AS ty,
    row_number() OVER (PARTITION BY viewport_id ORDER BY font DESC, pre) AS turn
  FROM sized WHERE font >= 12 AND room >= font + 4)
SELECT viewport_id, id, turn, round(font, 6) AS font,
  round(sx - (length(name) * font * 0.3 + 2), 5) AS x1, round(ty + font / 2 + 2, 5) AS y2
FROM tried"""


def _candidates(spark, sf):
    spaced = P.label_space(laid_out_line(spark, sf)).select("id", "space")
    return P.label_candidates(_visible(spark, sf).join(spaced, "id"))


@query(O.line_sql(_LABELS, labels=True))
def label_candidates(spark, sf):
    return _candidates(spark, sf).select("viewport_id", "id", "turn", *rounded("font"), *rounded("x1", "y2", digits=5))


@query(O.line_sql(_LABELS.replace("SELECT viewport_id, id, turn, round(font", ", cand AS (SELECT viewport_id, id, turn, sx - (length(name) * font * 0.3::DOUBLE + 2) AS x1, sx + (length(name) * font * 0.3::DOUBLE + 2) AS x2, ty - font / 2 - 2 AS y1, ty + font / 2 + 2 AS y2 FROM tried), unused AS (SELECT viewport_id, id, turn, round(font").rstrip() + """), greedy AS (
  SELECT viewport_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS id, false AS keep, CAST([] AS STRUCT(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[]) AS kept FROM viewports
  UNION ALL
  SELECT c.viewport_id, c.turn, c.id, h.clashes = 0, CASE WHEN h.clashes = 0 THEN list_append(g.kept, {'x1': c.x1, 'y1': c.y1, 'x2': c.x2, 'y2': c.y2}) ELSE g.kept END
  FROM greedy g JOIN cand c ON c.viewport_id = g.viewport_id AND c.turn = g.turn + 1,
    LATERAL (SELECT len(list_filter(g.kept, lambda o: c.x2 >= o.x1 AND c.x1 <= o.x2 AND c.y2 >= o.y1 AND c.y1 <= o.y2)) AS clashes) h)
SELECT viewport_id, id FROM greedy WHERE keep""", labels=True))
def place_labels(spark, sf):
    return P.place_labels(_candidates(spark, sf)).select("viewport_id", "id")


def _points(spark, sf):
    """Every event as a point, seen by a camera on the point."""
    wx = ((F.col("event_id") * 37) % 4000 - 2000).cast("double")
    wy = (F.col("user_id") % 7 - 3).cast("double")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("point_id"), wx.alias("wx"), wy.alias("wy"), wx.alias("cam_x"), wy.alias("cam_y"),
        F.lit(20.0).alias("k"), F.lit(1200.0).alias("w"), F.lit(800.0).alias("h"),
        F.when(F.col("event_id") % 4 == 0, 10 + F.col("event_id") % 5).alias("current_id"),
    )


_POINTS = """, points AS (
  SELECT event_id AS point_id, CAST((event_id * 37) % 4000 - 2000 AS DOUBLE) AS wx, CAST(user_id % 7 - 3 AS DOUBLE) AS wy, 20.0::DOUBLE AS k,
    CASE WHEN event_id % 4 = 0 THEN 10 + event_id % 5 END AS current_id FROM events
), bounded AS (SELECT p.*, c.pre AS lo, c.pre_end AS hi FROM points p LEFT JOIN lab c ON c.id = p.current_id
), circles AS (SELECT n.*, l.pre FROM geo_line n JOIN lab l ON l.id = n.id)"""
_NEAR = """(wx - x) * (wx - x) + (wy - y) * (wy - y) <= r * r AND r * k >= 10
    AND (x - wx) * (x - wx) + (y - wy) * (y - wy) <= (sqrt(1200.0::DOUBLE * 1200 + 800.0::DOUBLE * 800) * 0.5 / k + r) * (sqrt(1200.0::DOUBLE * 1200 + 800.0::DOUBLE * 800) * 0.5 / k + r)
    AND (current_id IS NULL OR pre BETWEEN lo AND hi)"""


@query(O.line_sql(_POINTS + f""", hits AS (
  SELECT point_id, id, name, level, row_number() OVER (PARTITION BY point_id ORDER BY level DESC, pre) AS rn
  FROM bounded JOIN circles ON {_NEAR})
SELECT point_id, id, name, level FROM hits WHERE rn = 1""", labels=True))
def pick(spark, sf):
    return P.pick(laid_out_line(spark, sf), _points(spark, sf))


@query(O.line_sql(_POINTS + f""", hover AS (SELECT b.*, 100 + point_id % 25 AS hover_id FROM bounded b)
SELECT point_id, hover_id AS id, {_NEAR} AS valid FROM hover JOIN circles ON id = hover_id""", labels=True))
def revalidate_hover(spark, sf):
    hovers = _points(spark, sf).withColumn("id", 100 + F.col("point_id") % 25)
    return P.revalidate_hover(laid_out_line(spark, sf), hovers).select("point_id", "id", "valid")


@query(O.line_sql(_VIEWPORTS + _RECT + """
SELECT v.viewport_id, n.id, (n.x - cam_x) * (n.x - cam_x) + (n.y - cam_y) * (n.y - cam_y)
  <= (sqrt(w * w + h * h) * 0.5 / k + r) * (sqrt(w * w + h * h) * 0.5 / k + r) AS near,
  n.x + n.r >= x0 AND n.x - n.r <= x1 AND n.y + n.r >= y0 AND n.y - n.r <= y1 AS boxed
FROM rects v JOIN geo_line n ON n.parent_id = v.viewport_id"""))
def in_view(spark, sf):
    """View radius and padded rectangle, for the children of each nation."""
    cam = G.camera()
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    pairs = _viewports(spark, sf).join(
        laid_out_line(spark, sf).select("id", F.col("parent_id").alias("viewport_id"), "x", "y", "r"), "viewport_id"
    )
    return pairs.select(
        "viewport_id", "id", G.in_view_radius(x, y, r, cam).alias("near"), G.in_viewport(x, y, r, cam).alias("boxed")
    )


@query(O.line_sql("""SELECT id, round(800.0 * 0.4 / r, 6) AS k, round(x, 6) AS cam_x FROM geo_line"""))
def fit_zoom(spark, sf):
    line = laid_out_line(spark, sf)
    k = G.fit_zoom(F.col("r"), F.lit(1200.0), F.lit(800.0))
    return line.select("id", F.round(k, 6).alias("k"), F.round("x", 6).alias("cam_x"))


@query(O.line_sql("""SELECT id, CASE WHEN r * 2 < 1 THEN 'pruned' WHEN r * 2 < 2 THEN 'simple' WHEN r * 2 < 8 THEN 'medium' ELSE 'detail' END AS lod,
  CASE WHEN r * 2 < 2 THEN NULL WHEN r * 2 < 8 THEN 1 ELSE round(greatest(1, least(3, 1.5 * sqrt(greatest(r * 2 / 40, 0.25)))), 6) END AS stroke
FROM geo_line"""))
def lod_class(spark, sf):
    """Detail class and outline at zoom 2, nodes below one pixel pruned."""
    sr = F.col("r") * 2
    lod = laid_out_line(spark, sf).withColumn("sr", sr).withColumn("lod", G.lod_class(sr, min_px=1.0))
    return lod.select("id", "lod", F.round(G.stroke_width(F.col("lod"), F.col("sr")), 6).alias("stroke"))


@query(O.line_sql("""SELECT id, level > 0 AND r * 3 < 10 * (1 + level * 0.5) AND level > 2 * power(0.7::DOUBLE, level) AS culled FROM geo_line"""))
def depth_cull(spark, sf):
    return laid_out_line(spark, sf).select("id", G.depth_culled(F.col("r") * 3, F.col("level"), base=2.0).alias("culled"))


@query(O.line_sql(f"SELECT id, ({G.BLUE_GRADIENT!r})[level % 38 + 1] AS blue, ({G.TABLEAU10!r})[level % 10 + 1] AS tableau, ({G.BLUE_ZIGZAG!r})[level % 37 + 1] AS zigzag FROM geo_line"))
def level_color(spark, sf):
    level = F.col("level")
    return laid_out_line(spark, sf).select(
        "id", G.level_color(level).alias("blue"), G.level_color(level, "tableau10").alias("tableau"),
        G.level_color(level, "blueZigzag").alias("zigzag"),
    )


@query(O.line_sql(_VIEWPORTS + """
SELECT n.id, round(w / 2 + (x - cam_x) * k, 5) AS sx, round(h / 2 + (y - cam_y) * k, 5) AS sy, round(x, 5) AS back_x, round(y, 5) AS back_y
FROM viewports JOIN geo_line n ON n.parent_id = viewport_id"""))
def world_to_screen(spark, sf):
    cam = G.camera()
    pairs = _viewports(spark, sf).join(
        laid_out_line(spark, sf).select("id", F.col("parent_id").alias("viewport_id"), "x", "y"), "viewport_id"
    )
    sx, sy = G.world_to_screen(F.col("x"), F.col("y"), cam)
    screen = pairs.withColumn("sx", sx).withColumn("sy", sy)
    bx, by = G.screen_to_world(F.col("sx"), F.col("sy"), cam)
    return screen.withColumn("back_x", bx).withColumn("back_y", by).select("id", *rounded("sx", "sy", "back_x", "back_y", digits=5))


# =============================================================================
# Layout and output
# =============================================================================


def _checked_layout(laid_out, size=4000.0, slack=1e-6):
    """Per node: inside its parent, number of siblings it overlaps, radius as a share of the family's largest leaf.

    Siblings meet in an equi-join on cells: each circle in the cells of its own zoom level,
    and of every coarser one in use. It touches at most four cells in each.
    """
    rows = laid_out.select("id", F.when(F.col("level") > 0, F.col("parent_id")).alias("parent_id"), "level", "child_count", "x", "y", "r")
    parent = rows.select(F.col("id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("r").alias("pr"))
    small = rows.filter("parent_id is not null").select("parent_id", "id", "x", "y", "r", P.zoom_of(F.col("r"), size).alias("z"))
    levels = F.filter(F.array(*[F.lit(z) for z in P.circle_zooms(laid_out, size)]), lambda z: z <= F.col("z"))
    cells = P.cells_touched(small.withColumn("_z", F.explode(levels)), size)
    own = cells.filter("_z = z")
    keys = ["parent_id", "_z", "_cx", "_cy"]
    big = own.select(*keys, *[F.col(n).alias(f"b{n}") for n in ("id", "x", "y", "r")])
    apart = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2)) >= F.col("r") + F.col("br") - slack * size
    met = cells.join(big, keys).filter((F.col("id") != F.col("bid")) & ~apart).select("id", "bid").distinct()
    pairs = met.union(met.select("bid", "id")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("overlaps"))
    leaf_r = F.when(F.col("child_count") == 0, F.col("r"))
    largest = rows.groupBy("parent_id").agg(F.max(leaf_r).alias("largest")).filter("parent_id is not null")
    reach = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)) + F.col("r")
    return rows.join(parent, "parent_id", "left").join(largest, "parent_id", "left").join(pairs, "id", "left").select(
        "id", "parent_id", "level",
        F.coalesce(reach <= F.col("pr") + slack * size, F.abs(F.col("r") - size / 2) < slack * size).alias("inside"),
        F.coalesce("overlaps", F.lit(0)).alias("overlaps"),
        F.round(leaf_r / F.col("largest"), 6).alias("share"),
    )


@query(O.labelled_sql("geo", """
SELECT id, parent_id, level, true AS inside, CAST(0 AS BIGINT) AS overlaps,
  CASE WHEN child_count = 0 AND parent_id IS NOT NULL THEN 1.0::DOUBLE END AS share FROM lab"""))
def circle_layout(spark, sf):
    """Every circle inside its parent and apart from its siblings; the root has half the size."""
    return _checked_layout(Y.circle_layout(labelled(spark, sf, "geo")))


@query(O.view_sql("geo", """
SELECT count(*) AS nodes, CAST(0 AS BIGINT) AS outside, 2000.0::DOUBLE AS root_radius, 1.0::DOUBLE AS leaf_area_ratio FROM geo"""))
def layout_invariants(spark, sf):
    """Every circle inside its parent, root radius, equal area per leaf."""
    laid = Y.circle_layout(labelled(spark, sf, "geo"))
    parent = laid.select(F.col("id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("r").alias("pr"))
    reach = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)) + F.col("r")
    leaf_r = F.when(F.col("child_count") == 0, F.col("r"))
    return laid.join(parent, "parent_id", "left").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(reach > F.col("pr") + 4e-3).alias("outside"),
        F.round(F.max(F.when(F.col("level") == 0, F.col("r"))), 6).alias("root_radius"),
        F.round(F.pow(F.max(leaf_r) / F.min(leaf_r), 2), 6).alias("leaf_area_ratio"),
    )


@query(O.labelled_sql("geo", """
SELECT id, child_count, true AS around_all, true AS smallest FROM lab WHERE child_count > 0"""))
def circle_layout_tight(spark, sf):
    """Per family: its circle holds every child, and no smaller circle does.

    A circle around others is the smallest if those that touch it from inside leave no
    gap of more than half a turn.
    """
    laid = Y.circle_layout(labelled(spark, sf, "geo"), tight=True)
    parent = laid.filter("child_count > 0").select("id", "child_count", *[F.col(c).alias(f"p{c}") for c in ("x", "y", "r")])
    child = laid.filter("level > 0").select(F.col("parent_id").alias("id"), "x", "y", "r")
    off_x, off_y = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    met = child.join(parent, "id").select(
        "id", "child_count", "pr", (F.hypot(off_x, off_y) + F.col("r") - F.col("pr")).alias("out"),
        F.hypot(off_x, off_y).alias("away"), F.atan2(off_y, off_x).alias("turn"),
    )
    touching = met.filter("abs(out) <= 1e-8 * pr")
    turns = Window.partitionBy("id").orderBy("turn")
    gaps = touching.withColumn("gap", F.col("turn") - F.lag("turn").over(turns)).groupBy("id").agg(
        F.greatest(F.max("gap"), F.min("turn") - F.max("turn") + 2 * math.pi).alias("gap"), F.min(F.col("away") / F.col("pr")).alias("nearest")
    )
    held = met.groupBy("id", "child_count").agg((F.max(F.col("out") / F.col("pr")) <= 1e-8).alias("around_all"))
    smallest = F.coalesce((F.col("gap") <= math.pi + 1e-4) | (F.col("nearest") <= 1e-8), F.lit(False))
    return held.join(gaps, "id", "left").select("id", "child_count", "around_all", smallest.alias("smallest"))


_TITLE_PLAIN = """array_to_string(list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1:1]) || w[2:] ELSE w END), '')"""
_TITLE = """array_to_string(list_transform(regexp_extract_all(lower({0}), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
  lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(w[1:1]) || w[2:] ELSE w END), '')"""


@query(f"""WITH RECURSIVE {O.view_ctes('geo_ph')}, {_SYN}, named AS (
  SELECT id, parent_id, CASE WHEN common_name IS NULL THEN name ELSE common_name || ' (' || name || ')' END AS name, name = 'sibling_higher' AND common_name IS NULL AS gone
  FROM geo_ph LEFT JOIN best ON ott_id = id
), lifted AS (
  SELECT k.id, CASE WHEN p.gone THEN p.parent_id ELSE k.parent_id END AS parent_id, k.name FROM named k LEFT JOIN named p ON p.id = k.parent_id WHERE NOT k.gone
), walk AS (
  SELECT id, name, 0 AS level, CAST(NULL AS VARCHAR) AS parent_name FROM lifted WHERE parent_id IS NULL
  UNION ALL SELECT l.id, l.name, w.level + 1, w.name FROM lifted l JOIN walk w ON l.parent_id = w.id)
SELECT {_TITLE.format('name')} AS name, level, CASE WHEN parent_name IS NULL THEN '' ELSE {_TITLE.format('parent_name')} END AS parent_name FROM walk""")
def bake_opentree(spark, sf):
    """Dump files to stored layout rows, all steps."""
    geo = view(spark, sf, "geo_ph")
    line = _bar(F.col("id"), F.col("parent_id"), F.col("name"), F.lit("no rank"), F.lit(""), F.lit(""))
    s = _bar(F.col("synonym"), F.col("ott_id"), F.lit("synonym"), F.col("synonym"), F.col("source"))
    # One file keeps the order of the lines, in which the first of equal synonyms wins.
    synonyms = _synonyms(spark, sf).orderBy("line_no")
    nodes, _ = B.opentree_nodes(spark, _text_file(geo, line, "taxonomy"), _text_file(synonyms, s, "synonyms"))
    baked = B.bake_layout(nodes)
    parents = baked.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return baked.join(parents, "parent_id", "left").select("name", "level", F.coalesce("parent_name", F.lit("")).alias("parent_name"))


@query(f"""WITH RECURSIVE {O.view_ctes('geo')}, named AS (
  SELECT id, parent_id, CASE WHEN id = 1 THEN name WHEN id % 4 = 0 THEN concat('Unknown_', CAST(id AS STRING)) ELSE name END AS name FROM geo
), walk AS (
  SELECT id, name, 0 AS level, CAST(NULL AS VARCHAR) AS parent_name FROM named WHERE parent_id IS NULL
  UNION ALL SELECT l.id, l.name, w.level + 1, w.name FROM named l JOIN walk w ON l.parent_id = w.id)
SELECT {_TITLE_PLAIN.format('name')} AS name, level, CASE WHEN parent_name IS NULL THEN '' ELSE {_TITLE_PLAIN.format('parent_name')} END AS parent_name FROM walk""")
def bake_ncbi(spark, sf):
    """Both dump files to stored layout rows, all steps; the last of two scientific names counts."""
    geo = view(spark, sf, "geo")
    node = F.concat(_bar(F.col("id"), F.coalesce("parent_id", "id"), F.lit("genus"), F.lit("XX")), F.lit("\t|"))
    kind = F.when(F.col("id") % 4 == 0, "synonym").otherwise("scientific name")
    both = union(geo.withColumn("turn", F.lit(1)).withColumn("name", F.lit("earlier")), geo.withColumn("turn", F.lit(2)))
    name = F.concat(_bar(F.col("id"), F.col("name"), F.lit(""), kind), F.lit("\t|"))
    nodes, _ = B.ncbi_nodes(spark, _text_file(geo, node, "nodes"), _text_file(both.orderBy("turn", "id"), name, "names"))
    baked = B.bake_layout(nodes)
    parents = baked.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return baked.join(parents, "parent_id", "left").select("name", "level", F.coalesce("parent_name", F.lit("")).alias("parent_name"))


@query(O.labelled_sql("product", """, valued AS (SELECT *, CASE WHEN child_count = 0 THEN id % 97 + 1 END AS v FROM lab)
SELECT id, parent_id, level, true AS inside, CAST(0 AS BIGINT) AS overlaps,
  CASE WHEN child_count = 0 AND parent_id IS NOT NULL
    THEN round(sqrt(v::DOUBLE / max(v) OVER (PARTITION BY parent_id)), 6) END AS share FROM valued"""))
def circle_layout_variants(spark, sf):
    """Circles of many sizes in one family, values of the caller, alphabetical order."""
    value = F.when(F.col("child_count") == 0, F.col("id") % 97 + 1).otherwise(0).cast("bigint")
    return _checked_layout(Y.circle_layout(labelled(spark, sf, "product"), value=value, strategy="name"))


@query(O.line_sql(""", ranked AS (SELECT g.*, row_number() OVER (ORDER BY g.level, l.k) AS bfs FROM geo_line g JOIN lab l ON l.id = g.id)
SELECT a.bfs AS id, b.bfs AS parent_id, a.name, a.level, floor(a.x * 100 + 0.5) / 100 AS x, floor(a.y * 100 + 0.5) / 100 AS y, floor(a.r * 100 + 0.5) / 100 AS r
FROM ranked a LEFT JOIN ranked b ON b.id = a.parent_id""", labels=True))
def flatten_layout(spark, sf):
    line = laid_out_line(spark, sf)
    return Y.flatten_layout(L.sibling_order(line.drop("path_ids", "path_names")))


_PARTS = """, ranked AS (SELECT *, row_number() OVER (ORDER BY level, k) AS bfs FROM lab
), parts AS (SELECT *, CAST((bfs - 1) // CAST(ceil((SELECT count(*) FROM lab) / 5.0) AS BIGINT) AS INTEGER) AS part FROM ranked)"""


def _parted(spark, sf):
    return A.split_parts(L.bfs_ids(_narrow(spark, sf)))


_JSON_BYTES = "strlen(CAST(to_json({'id': id, 'parent_id': parent_id, 'name': name, 'level': level}) AS VARCHAR)) + 1"


@query(O.labelled_sql("geo", _PARTS + " SELECT id, part FROM parts"))
def write_layout_parts(spark, sf):
    """Parts written as JSON and read back."""
    path = scratch_path(spark, "parts")
    A.write_layout_parts(_parted(spark, sf), path, ["id", "parent_id", "name", "level"], position="bfs")
    return spark.read.schema("id bigint, part int").json(path).select("id", "part")


@query(O.labelled_sql("geo", _PARTS + f"""
SELECT 'tree_part_00' || (part + 1) || '.json' AS filename, count(*) AS nodes_count, CAST(sum({_JSON_BYTES}) + 1 AS BIGINT) AS size_bytes FROM parts GROUP BY part"""))
def part_stats(spark, sf):
    return A.part_stats(_parted(spark, sf), ["id", "parent_id", "name", "level"]).select("filename", "nodes_count", "size_bytes")


def _written(spark, sf):
    """(path of the parts, path of their manifest), written."""
    path = scratch_path(spark, "written")
    A.write_layout_parts(_parted(spark, sf), f"{path}/parts", ["id", "parent_id", "name", "level"], position="bfs")
    manifest = A.build_manifest(A.written_parts(spark, f"{path}/parts"), sort_method="hybrid")
    A.write_manifest(manifest, f"{path}/manifest")
    return f"{path}/parts", f"{path}/manifest"


@query(O.labelled_sql("geo", _PARTS + f"""
SELECT '1.0' AS version, 4000.0::DOUBLE AS layout_size, 'hybrid' AS sort_method, (SELECT count(*) FROM parts) AS total_nodes,
  part, count(*) AS nodes_count, CAST(sum({_JSON_BYTES}) AS BIGINT) AS size_bytes FROM parts GROUP BY part"""))
def write_manifest(spark, sf):
    """Manifest of the written files, read back and validated; counts and bytes by part."""
    read = A.read_manifest(spark, _written(spark, sf)[1])
    part = F.regexp_extract("f.filename", r"part=(\d+)/", 1).cast("int").alias("part")
    return (
        read.select("version", "layout_size", "sort_method", "total_nodes", F.explode("files").alias("f"))
        .groupBy("version", "layout_size", "sort_method", "total_nodes", part)
        .agg(F.sum("f.nodes_count").alias("nodes_count"), F.sum("f.size_bytes").alias("size_bytes"))
    )


@query(O.labelled_sql("geo", _PARTS + """
SELECT CAST(part AS VARCHAR) AS part, count(*) AS declared, count(*) AS found, true AS ok FROM parts GROUP BY part
UNION ALL SELECT 'total', count(*), count(*), true FROM parts"""))
def manifest_audit(spark, sf):
    """What the manifest declares against the files read again."""
    parts, manifest = _written(spark, sf)
    audit = A.manifest_audit(A.read_manifest(spark, manifest), A.written_parts(spark, parts))
    part = F.coalesce(F.nullif(F.regexp_extract("filename", r"part=(\d+)/", 1), F.lit("")), "filename").alias("part")
    return audit.groupBy(part).agg(F.sum("declared").alias("declared"), F.sum("found").alias("found"), F.min("ok").alias("ok"))


@query(O.labelled_sql("geo", _PARTS + " SELECT id, parent_id, name, level FROM parts"))
def read_from_manifest(spark, sf):
    """Rows of the files that the manifest lists."""
    parts, manifest = _written(spark, sf)
    return A.read_from_manifest(spark, manifest, parts)[0].select("id", "parent_id", "name", "level")


@query(O.view_sql("geo", """
SELECT 'part' AS source, count(*) AS rejected FROM geo WHERE id % 7 IN (2, 3)
UNION ALL SELECT 'taxonomy', count(*) FROM geo WHERE id % 5 = 1 AND id > 1
UNION ALL SELECT 'names', count(*) FROM geo WHERE id % 4 = 3"""))
def rejected_lines(spark, sf):
    """Damaged lines among good ones: none vanishes unseen."""
    geo = view(spark, sf, "geo")
    node = F.to_json(F.struct("id", "parent_id", "name"))
    damaged = F.when(F.col("id") % 7 == 2, F.concat(F.lit("{"), node)).when(F.col("id") % 7 == 3, '{"name":"no id"}').otherwise(node)
    parts = A.read_layout_parts(spark, _text_file(geo, damaged, "damaged"), multi_line=False)[1]
    line = F.when((F.col("id") % 5 == 1) & (F.col("id") > 1), "lost\tott_id").otherwise(
        _bar(F.col("id"), F.col("parent_id"), F.col("name"), F.lit("genus"))
    )
    taxonomy = X.read_opentree_taxonomy(spark, _text_file(geo, line, "taxonomy"))[1]
    name = F.when(F.col("id") % 4 == 3, F.concat(F.lit("x"), _bar(F.col("id"), F.col("name"), F.lit(""), F.lit("synonym")))).otherwise(
        _bar(F.col("id"), F.col("name"), F.lit(""), F.lit("synonym"))
    )
    names = X.read_ncbi_names(spark, _text_file(geo, name, "names"))[1]
    return union(*[
        df.agg(F.count(F.lit(1)).alias("rejected")).select(F.lit(s).alias("source"), "rejected")
        for s, df in {"part": parts, "taxonomy": taxonomy, "names": names}.items()
    ])


@query(O.line_sql("SELECT id, parent_id, name, level, x, y, r FROM geo_line"))
def read_layout_parts(spark, sf):
    """geo_line written as JSON and read with the node schema."""
    path = scratch_path(spark, "read-parts")
    line = laid_out_line(spark, sf).withColumn("part", F.col("level"))
    A.write_layout_parts(line, path)
    return A.read_layout_parts(spark, path, multi_line=False)[0].select("id", "parent_id", "name", "level", "x", "y", "r")


@query(O.line_sql("SELECT id, level AS part FROM geo_line"))
def concat_parts(spark, sf):
    """Parts read one by one and joined in order."""
    path = scratch_path(spark, "concat")
    line = laid_out_line(spark, sf).withColumn("part", F.col("level"))
    A.write_layout_parts(line, path)
    parts = [A.read_layout_parts(spark, f"{path}/part={p}", multi_line=False)[0].withColumn("part", F.lit(p)) for p in range(5)]
    return union(*parts).select("id", "part")


@query(O.view_sql("geo", "SELECT id, CAST(to_json({'id': id, 'parent_id': parent_id, 'name': name}) AS VARCHAR) AS json FROM geo"))
def json_node(spark, sf):
    return view(spark, sf, "geo").select("id", T.json_node(F.struct("id", "parent_id", "name")).alias("json"))


@query(O.labelled_sql("geo", """, kid AS (
  SELECT parent_id, id, name, row_number() OVER (PARTITION BY parent_id ORDER BY k) AS ord FROM lab WHERE parent_id IS NOT NULL)
SELECT p.id, p.name, CAST((ord - 1) // 16 AS INTEGER) AS chunk, string_agg(kid.name, '|' ORDER BY ord) AS children, count(*) AS n
FROM kid JOIN lab p ON p.id = kid.parent_id GROUP BY 1, 2, 3"""))
def adjacency_export(spark, sf):
    """Families in chunks of 16 children."""
    out = A.adjacency_export(labelled(spark, sf, "geo"), 16)
    return out.select("id", "name", "chunk", F.array_join("children.name", "|").alias("children"), F.size("children").cast("bigint").alias("n"))


@query(O.labelled_sql("geo", f""", sized AS (
  SELECT id, parent_id, level, pre, child_count, length(CAST(to_json({{'name': name, 'level': level, '_leaves': leaf_count}}) AS VARCHAR)) AS own,
    'data/' || array_to_string(list_transform(names, lambda n: {O.uri('n')}), '/') || '.json' AS key FROM lab
), sums AS (
  SELECT parent_id AS id, sum(own) AS plain, sum(own + CASE WHEN child_count > 0 THEN length(key) + 12 ELSE 0 END) AS refs FROM sized GROUP BY parent_id
), forms AS (
  SELECT z.*, own + 14 AS opened, own + 14 + coalesce(plain, 0) + greatest(child_count - 1, 0) AS tested,
    own + 14 + coalesce(refs, 0) + greatest(child_count - 1, 0) AS inlined, own + length(key) + 12 AS stub,
    row_number() OVER (PARTITION BY z.parent_id ORDER BY pre) AS ord
  FROM sized z LEFT JOIN sums s ON s.id = z.id
), fold AS (
  SELECT id AS parent_id, CAST(0 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS id, false AS cut, CAST(opened AS BIGINT) AS so_far FROM forms WHERE child_count > 0
  UNION ALL
  SELECT c.parent_id, c.ord, c.id, d.cut, CAST(f.so_far + CASE WHEN d.cut THEN c.stub ELSE c.inlined END + CASE WHEN c.ord > 1 THEN 1 ELSE 0 END AS BIGINT)
  FROM fold f JOIN forms c ON c.parent_id = f.parent_id AND c.ord = f.ord + 1,
    LATERAL (SELECT c.child_count > 0 AND (2 + f.so_far + c.tested > 20000 OR c.ord > 50) AS cut) d
), decided AS (SELECT f.parent_id, f.ord, f.id, f.cut, c.key, c.child_count FROM fold f JOIN forms c ON c.id = f.id
), shard AS (
  SELECT id, true AS is_root FROM forms WHERE parent_id IS NULL
  UNION ALL SELECT d.id, CASE WHEN s.is_root THEN d.cut ELSE true END FROM shard s JOIN decided d ON d.parent_id = s.id WHERE d.child_count > 0
), direct AS (
  SELECT s.id AS shard_id, d.id AS child_id, d.cut AS is_stub, CASE WHEN d.cut THEN d.key END AS shard_ref
  FROM shard s JOIN decided d ON d.parent_id = s.id WHERE s.is_root)
SELECT * FROM direct
UNION ALL SELECT x.shard_id, d.id, true, CASE WHEN d.child_count > 0 THEN d.key END FROM direct x JOIN decided d ON d.parent_id = x.child_id WHERE NOT x.is_stub"""))
def shard_by_budget(spark, sf):
    cut = A.shard_by_budget(labelled(spark, sf, "geo"), max_bytes=20_000, max_children=50)
    return cut.select("shard_id", "child_id", "is_stub", "shard_ref")


_SHARDS, _SHARD_ROWS = ORACLES["shard_by_budget"].rsplit("\nSELECT * FROM direct\n", 1)


@query(f"""{_SHARDS}, rows_ AS (SELECT * FROM direct
{_SHARD_ROWS}), lines AS (
  SELECT shard_id, child_id AS id, shard_ref FROM rows_ UNION ALL SELECT DISTINCT shard_id, shard_id, CAST(NULL AS VARCHAR) FROM rows_)
SELECT s.shard_id, s.id, l.name, l.level, l.leaf_count AS leaves, s.shard_ref, n.lines
FROM lines s JOIN lab l ON l.id = s.id JOIN (SELECT shard_id, count(*) AS lines FROM lines GROUP BY shard_id) n ON n.shard_id = s.shard_id""")
def shard_documents(spark, sf):
    """Shards written as JSON lines and read back, with the line counts of their manifest."""
    path = scratch_path(spark, "shards")
    manifest = A.write_shard_documents(labelled(spark, sf, "geo"), path, max_bytes=20_000, max_children=50)
    lines = spark.read.schema("id bigint, name string, level int, leaves bigint, _shard string, shard_id bigint").json(path)
    return lines.join(manifest.select("shard_id", "lines"), "shard_id").select(
        "shard_id", "id", "name", "level", "leaves", F.col("_shard").alias("shard_ref"), "lines"
    )


@query(O.labelled_sql("geo", "SELECT name, level, leaf_count AS leaves, 'data/Life.json' AS shard FROM lab WHERE level = 0"))
def shard_manifest(spark, sf):
    return A.shard_manifest(labelled(spark, sf, "geo"))


# =============================================================================
# Sources: files derived from the tables, read with the readers
# =============================================================================


def _text_file(df: DataFrame, line, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.select(line.alias("value")).write.text(path)
    return path


def _bar(*fields):
    return F.concat_ws("\t|\t", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


@query(O.view_sql("geo", """
SELECT id, parent_id, CASE WHEN id % 11 = 0 THEN concat('Unknown_', CAST(id AS STRING)) ELSE name END AS name,
  CASE WHEN id % 2 = 0 THEN 'no rank' ELSE 'species' END AS rank FROM geo"""))
def read_opentree_taxonomy(spark, sf):
    """Both delimiters, blank names and ranks."""
    geo = view(spark, sf, "geo")
    name = F.when(F.col("id") % 11 == 0, F.lit(" ")).otherwise(F.col("name"))
    rank = F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.lit("species"))
    wide = _bar(F.col("id"), F.col("parent_id"), name, rank, F.lit(""), F.lit(""))
    line = F.when(F.col("id") % 3 == 0, F.replace(wide, F.lit("\t|\t"), F.lit("\t"))).otherwise(wide)
    path = _text_file(geo, line, "taxonomy")
    return X.read_opentree_taxonomy(spark, path)[0].select("id", "parent_id", "name", "rank")


@query(O.view_sql("synonyms", "SELECT synonym, ott_id, source FROM synonyms"))
def read_opentree_synonyms(spark, sf):
    line = _bar(F.col("synonym"), F.col("ott_id"), F.lit("synonym"), F.col("synonym"), F.col("source"))
    path = _text_file(view(spark, sf, "synonyms"), line, "synonyms")
    return X.read_opentree_synonyms(spark, path)[0].select("synonym", "ott_id", "source")


def _ncbi_nodes(spark, sf):
    geo = view(spark, sf, "geo").withColumn("parent_id", F.coalesce("parent_id", "id"))
    line = F.concat(_bar(F.col("id"), F.col("parent_id"), F.lit("genus"), F.lit("XX")), F.lit("\t|"))
    return X.read_ncbi_nodes(spark, _text_file(geo, line, "nodes"))[0]


def _ncbi_names(spark, sf):
    geo = view(spark, sf, "geo")
    kind = F.when(F.col("id") % 4 == 0, "synonym").otherwise("scientific name")
    line = F.concat(_bar(F.col("id"), F.col("name"), F.lit(""), kind), F.lit("\t|"))
    return X.read_ncbi_names(spark, _text_file(geo, line, "names"))[0]


@query(O.view_sql("geo", "SELECT id, coalesce(parent_id, id) AS parent_id, 'genus' AS rank FROM geo"))
def read_ncbi_nodes(spark, sf):
    return _ncbi_nodes(spark, sf).select("id", "parent_id", "rank")


@query(O.view_sql("geo", "SELECT id AS tax_id, name, CASE WHEN id % 4 = 0 THEN 'synonym' ELSE 'scientific name' END AS name_class FROM geo"))
def read_ncbi_names(spark, sf):
    return _ncbi_names(spark, sf).select("tax_id", "name", "name_class")


@query(O.view_sql("geo", "SELECT id AS tax_id, name FROM geo WHERE id % 4 <> 0"))
def last_scientific_name(spark, sf):
    return C.last_scientific_name(_ncbi_names(spark, sf))


@query(O.view_sql("geo", "SELECT id, CASE WHEN id % 4 = 0 THEN concat('Unknown_', CAST(id AS STRING)) ELSE name END AS name FROM geo"))
def attach_names(spark, sf):
    nodes = _ncbi_nodes(spark, sf)
    return C.attach_names(nodes, C.last_scientific_name(_ncbi_names(spark, sf))).select("id", "name")


def _order_docs(spark, sf):
    """A small nested document per order."""
    node = F.struct(
        F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("name"),
        F.array(
            F.to_json(F.struct(F.col("o_orderstatus").alias("name"))),
            F.to_json(F.struct(F.col("o_orderpriority").alias("name"), F.struct(F.lit("deep").alias("name")).alias("children"))),
        ).alias("kids"),
    )
    return spread(table(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit('{"name":"x","children":[{"name":"'), node["name"], F.lit('","children":['), F.array_join(node["kids"], ","), F.lit("]},7]}")).alias("json"),
    )


@query("""
SELECT o_orderkey AS doc_id, '' AS path, 0 AS level, 'Life' AS name, CAST(1 AS BIGINT) AS child_count FROM orders
UNION ALL SELECT o_orderkey, '0', 1, 'Order#' || o_orderkey, 2 FROM orders
UNION ALL SELECT o_orderkey, '0/0', 2, o_orderstatus, 0 FROM orders
UNION ALL SELECT o_orderkey, '0/1', 2, o_orderpriority, 1 FROM orders
UNION ALL SELECT o_orderkey, '0/1/0', 3, 'deep', 0 FROM orders""")
def flatten_tree_json(spark, sf):
    flat = N.flatten_tree_json(_order_docs(spark, sf))
    return flat.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/")).select("doc_id", "path", "level", "name", "child_count")


def _large_documents(docs, key, first, between, last):
    """One JSON document per sorted slice of ``docs(key, json)``, a line for each row; the folder's path."""
    marked = mark_ends(docs.repartitionByRange(key).sortWithinPartitions(key).select("json"))
    line = F.concat(F.when(F.col("_first"), first).otherwise(between), "json", F.when(F.col("_last"), last).otherwise(""))
    return _text_file(marked, line, "large-json")


def _with_parent_names(nodes, *columns):
    nodes = materialize(nodes, "named")
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return join_shared(nodes, parents, "parent_id").select("name", "level", "parent_name", *columns)


@query("""
SELECT 'x' AS name, 1 AS level, 'Life' AS parent_name FROM orders
UNION ALL SELECT 'Order#' || o_orderkey, 2, 'x' FROM orders
UNION ALL SELECT o_orderstatus, 3, 'Order#' || o_orderkey FROM orders
UNION ALL SELECT o_orderpriority, 3, 'Order#' || o_orderkey FROM orders
UNION ALL SELECT 'deep', 4, o_orderpriority FROM orders""")
def read_tree_json(spark, sf):
    """All orders in a few documents, each of which several tasks read."""
    nodes = N.read_tree_json(spark, _large_documents(_order_docs(spark, sf), "doc_id", "[", ",", "]"))
    return _with_parent_names(nodes).filter("level > 0")


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS name, 1 AS level, CAST(NULL AS VARCHAR) AS parent_name, false AS is_leaf FROM part
UNION ALL SELECT p_brand, 2, CAST(p_partkey AS VARCHAR), false FROM part
UNION ALL SELECT p_type, 3, p_brand, false FROM part
UNION ALL SELECT p_name, 4, p_type, p_size % 3 <> 2 FROM part
UNION ALL SELECT 's' || p_size, 5, p_name, true FROM part WHERE p_size % 3 = 2""")
def read_key_map(spark, sf):
    """All parts in a few documents, keyed by part."""
    part = F.concat(F.lit('"'), F.col("part_no").cast("string"), F.lit('":'), "json")
    maps = _part_maps(spark, sf).select("part_no", part.alias("json"))
    return _with_parent_names(N.read_key_map(spark, _large_documents(maps, "part_no", "{", ",", "}")), "is_leaf")


def _part_maps(spark, sf):
    """{brand: {type: {name: ...}}} per part; the end is {}, a scalar or an object."""
    end = (
        F.when(F.col("p_size") % 3 == 0, "{}")
        .when(F.col("p_size") % 3 == 1, F.col("p_size").cast("string"))
        .otherwise(F.concat(F.lit('{"s'), F.col("p_size").cast("string"), F.lit('":{}}')))
    )
    return spread(table(spark, sf, "part")).select(
        F.col("p_partkey").alias("part_no"),
        F.concat(F.lit('{"'), "p_brand", F.lit('":{"'), "p_type", F.lit('":{"'), "p_name", F.lit('":'), end, F.lit("}}}")).alias("json"),
    )


@query("""
SELECT p_partkey AS doc_id, p_brand AS path, 1 AS level, false AS is_leaf FROM part
UNION ALL SELECT p_partkey, p_brand || '/' || p_type, 2, false FROM part
UNION ALL SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name, 3, p_size % 3 <> 2 FROM part
UNION ALL SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name || '/s' || p_size, 4, true FROM part WHERE p_size % 3 = 2""")
def flatten_key_map(spark, sf):
    flat = N.flatten_key_map(_part_maps(spark, sf).withColumnRenamed("part_no", "doc_id"))
    return flat.select("doc_id", F.array_join("path", "/").alias("path"), "level", "is_leaf")


@query("""
WITH ends AS (SELECT *, p_brand || '/' || p_type || '/' || p_name AS path FROM part),
scalars AS (SELECT path, max(p_partkey) AS last FROM ends WHERE p_size % 3 = 1 GROUP BY 1),
deep AS (SELECT DISTINCT e.path AS up, e.path || '/s' || p_size AS path FROM ends e LEFT JOIN scalars s ON s.path = e.path
  WHERE p_size % 3 = 2 AND (s.last IS NULL OR s.last < p_partkey))
SELECT DISTINCT p_brand AS path, false AS is_leaf FROM part
UNION ALL SELECT DISTINCT p_brand || '/' || p_type, false FROM part
UNION ALL SELECT DISTINCT path, path NOT IN (SELECT up FROM deep) FROM ends
UNION ALL SELECT path, true FROM deep""")
def merge_key_maps(spark, sf):
    """All part maps merged in key order."""
    return N.merge_key_maps(_part_maps(spark, sf)).select(F.array_join("path", "/").alias("path"), "is_leaf")


# =============================================================================
# Telemetry
# =============================================================================


@query("""WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) / 1000.0::DOUBLE AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), f AS (
  SELECT event_id, user_id, ms, n, 0.0::DOUBLE AS lag FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.user_id, e.ms, e.n, greatest(0.0::DOUBLE, 0.2::DOUBLE * (e.ms - f.ms - 500) + 0.8::DOUBLE * f.lag)
  FROM e JOIN f ON f.user_id = e.user_id AND e.n = f.n + 1)
SELECT event_id, user_id, round(lag, 2) AS lag_ms, lag > 0.5 AS alert FROM f""")
def ewma_lag(spark, sf):
    lag = M.ewma_lag(table(spark, sf, "events"), "user_id", "ts", "event_id")
    return lag.select("event_id", "user_id", F.round("lag_ms", 2).alias("lag_ms"), "alert")


@query("""SELECT event_type, epoch_us(time_bucket(INTERVAL '1 minute', ts)) AS window_us, count(*) AS events,
  CAST(floor(count(*) / 60.0::DOUBLE + 0.5) AS BIGINT) AS rate,
  CAST(CASE WHEN floor(count(*) / 60.0::DOUBLE + 0.5) > 0 THEN floor(1000 / floor(count(*) / 60.0::DOUBLE + 0.5) + 0.5) ELSE 0 END AS BIGINT) AS ms_per_event
FROM events GROUP BY 1, 2""")
def event_rate(spark, sf):
    """Rates per event type and minute."""
    rates = M.event_rate(table(spark, sf, "events"), "event_type", "ts", 60_000)
    return rates.withColumn("window_us", (M.millis(rates, "window_start") * 1000).cast("bigint")).drop("window_start")


# Pointers to the closing event, then a walk from the first event of every type.
@query("""
WITH RECURSIVE timed AS MATERIALIZED (
  SELECT event_type, ts, epoch_us(ts) / 1000.0::DOUBLE AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
jumps AS MATERIALIZED (SELECT t.event_type, t.n, min(f.n) AS next FROM timed t JOIN timed f ON t.event_type = f.event_type AND f.ms >= t.ms + 600000 GROUP BY 1, 2),
closes AS (
  SELECT event_type, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS before FROM timed GROUP BY 1
  UNION ALL SELECT j.event_type, j.next, j.n FROM closes c JOIN jumps j ON j.event_type = c.event_type AND j.n = c.n),
windows AS (
  SELECT c.event_type, c.n - c.before AS events, (b.ms - a.ms) / 1000 AS sec, epoch_us(a.ts) AS started_us, epoch_us(b.ts) AS closed_us FROM closes c
  JOIN timed a ON a.event_type = c.event_type AND a.n = c.before JOIN timed b ON b.event_type = c.event_type AND b.n = c.n)
SELECT event_type, started_us, closed_us, events, CAST(floor(events / sec + 0.5) AS BIGINT) AS rate,
  CAST(CASE WHEN floor(events / sec + 0.5) > 0 THEN floor(1000 / floor(events / sec + 0.5) + 0.5) ELSE 0 END AS BIGINT) AS ms_per_event FROM windows""")
def event_rate_closing(spark, sf):
    """Rates per event type in windows of ten minutes or more, closed by events."""
    rates = M.event_rate_closing(table(spark, sf, "events"), "event_type", "ts", "event_id", 600_000)
    micros = [(M.millis(rates, c) * 1000).cast("bigint").alias(f"{c}_us") for c in ("started", "closed")]
    return rates.select("event_type", *micros, "events", "rate", "ms_per_event")


def _event_stream(spark, sf):
    """The events as files in time order, rows up to five minutes late; the last file is far ahead."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    late = F.unix_seconds("ts") + F.pmod(F.xxhash64("event_id"), F.lit(300))
    ends = events.agg(F.min(late).alias("a"), (F.max(late) + 1).alias("b")).first()
    slice_ = F.floor((late - ends["a"]) * 5 / (ends["b"] - ends["a"]))
    path = scratch_path(spark, "stream")
    for i in range(5):
        events.filter(slice_ == i).coalesce(1).write.mode("append").parquet(path)
    ahead = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast(dict(events.dtypes)["user_id"]).alias("user_id"),
        F.lit("end").alias("event_type"), F.timestamp_seconds(F.lit(ends["b"] + 86400)).alias("ts"),
    )
    ahead.write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(stream, label):
    """All that the stream emits, from a written table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query(ORACLES["ewma_lag"])
def ewma_lag_stream(spark, sf):
    """The streaming form over files with late rows: the rows of the batch form."""
    lag = _drained(M.ewma_lag_stream(_event_stream(spark, sf), "user_id", "ts", "event_id"), "lag")
    return lag.filter("event_id >= 0").select("event_id", "user_id", F.round("lag_ms", 2).alias("lag_ms"), "alert")


@query(ORACLES["event_rate"])
def event_rate_stream(spark, sf):
    """Windows emitted once the watermark has passed them."""
    stream = _event_stream(spark, sf).withWatermark("ts", "10 minutes")
    rates = _drained(M.event_rate(stream, "event_type", "ts", 60_000), "rate").filter("event_type <> 'end'")
    return rates.withColumn("window_us", (M.millis(rates, "window_start") * 1000).cast("bigint")).drop("window_start")
