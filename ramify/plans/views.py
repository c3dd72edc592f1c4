"""Hierarchies derived from the star-schema tables.

The SQL runs unchanged in Spark and as the common table expressions of the
comparison queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.operators.labels import label_hierarchy, sibling_order
from ramify.operators.ranking import grouped_running
from ramify.operators.shared_keys import join_shared
from ramify.sources.stored import store_for_lookup
from ramify.store import materialize, on_release, scratch_path, transient

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEW_SQL: dict[str, str] = {
    "geo": """
SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'Life' AS name
UNION ALL SELECT 10 + r_regionkey, 1, r_name FROM region
UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, n_name FROM nation
UNION ALL SELECT 1000000 + c_custkey, 100 + c_nationkey, c_name FROM customer
UNION ALL SELECT 100000000 + o_orderkey, 1000000 + o_custkey, concat('Order#', CAST(o_orderkey AS STRING)) FROM orders""",
    "geo_full": """
SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'Life' AS name
UNION ALL SELECT 10 + r_regionkey, 1, r_name FROM region
UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, n_name FROM nation
UNION ALL SELECT 1000000 + c_custkey, 100 + c_nationkey, c_name FROM customer
UNION ALL SELECT 100000000 + o_orderkey, 1000000 + o_custkey, concat('Order#', CAST(o_orderkey AS STRING)) FROM orders
UNION ALL SELECT DISTINCT 10000000000 + 10 * l_orderkey + l_linenumber, 100000000 + l_orderkey, concat('Line#', CAST(l_linenumber AS STRING)) FROM lineitem""",
    "product": """
SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'Parts' AS name
UNION ALL SELECT DISTINCT 100 + CAST(substr(p_brand, 7) AS BIGINT), 1, p_brand FROM part
UNION ALL SELECT 1000000 + p_partkey, 100 + CAST(substr(p_brand, 7) AS BIGINT), concat(p_name, ' ', CAST(p_size AS STRING)) FROM part""",
    "chain": """
SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_id, event_type AS name FROM events""",
    "talk": """
SELECT conv_id * 1000 + turn + 1 AS id, CASE WHEN turn = 0 THEN CAST(NULL AS BIGINT) ELSE conv_id * 1000 + turn END AS parent_id, role AS name FROM conversations""",
    "synonyms": """
SELECT p_partkey AS line_no, p_name AS synonym, 100 + p_partkey % 25 AS ott_id, p_brand AS source FROM part""",
    "geo_ph": """
SELECT id, parent_id, CASE WHEN id BETWEEN 100 AND 124 AND id % 5 = 0 THEN 'sibling_higher' ELSE name END AS name FROM geo""",
}
FOREST = {"chain", "talk"}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the tables of ``sf_dir``."""
    sql = VIEW_SQL[name]
    if name == "chain":
        # The window of the SQL form would put a whole user in one task.
        numbered = grouped_running(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "n")
        before = numbered.select("user_id", (F.col("n") + 1).alias("n"), F.col("event_id").alias("parent_id"))
        return numbered.join(before, ["user_id", "n"], "left").select(
            F.col("event_id").alias("id"), "parent_id", F.col("event_type").alias("name")
        )
    if name == "geo_ph":
        return spark.sql(sql.replace("FROM geo", "FROM {geo}"), geo=view(spark, sf_dir, "geo"))
    used = [t for t in TABLES if f"FROM {t}" in sql]
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


_labelled: dict[tuple[str, str, str], DataFrame] = {}


def _forget(application: str) -> None:
    for key in [k for k in _labelled if k[0] == application]:
        del _labelled[key]


on_release(_forget)


def labelled(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Labelled table of a view: written once per session, then reused."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _labelled:
        roots = "many" if name in FOREST else "one"
        _labelled[key] = label_hierarchy(view(spark, sf_dir, name), roots=roots)
    return _labelled[key]


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Labelled table of a view in buckets of its ids: written once per session, then reused."""
    key = (spark.sparkContext.applicationId, sf_dir, f"{name}_stored")
    if key not in _labelled:
        path = scratch_path(spark, "stored")
        _labelled[key] = store_for_lookup(labelled(spark, sf_dir, name), path.rsplit("/", 1)[1].replace("-", "_"), path)
    return _labelled[key]


def laid_out_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled geo with x, y, r: children side by side on the parent's diameter.

    One equi-join per level of the rows that have children, without paths; all rows are
    then placed in one join. Written once per session.
    """
    key = (spark.sparkContext.applicationId, sf_dir, "geo_line")
    if key not in _labelled:
        tree = labelled(spark, sf_dir, "geo")
        with transient(spark):
            geo, seen = materialize(sibling_order(tree), "line-order", {"depth": F.max("level")})
            zero = F.lit(0.0)
            at_root = {"x": zero, "y": zero, "r": F.lit(2000.0)}

            def placed(rows: DataFrame, above: DataFrame) -> DataFrame:
                return (
                    join_shared(rows, above, "parent_id", "inner")
                    .filter(F.col("level") == F.col("_level") + 1)
                    .withColumn("x", F.col("_x") + F.col("_r") * (2 * F.col("ord") - 1 - F.col("_n")) / F.col("_n"))
                    .withColumn("y", F.col("_y"))
                    .withColumn("r", F.col("_r") / F.col("_n"))
                )

            def as_parents(rows: DataFrame) -> DataFrame:
                return rows.select(
                    F.col("id").alias("parent_id"), F.col("x").alias("_x"), F.col("y").alias("_y"),
                    F.col("r").alias("_r"), F.col("child_count").alias("_n"), F.col("level").alias("_level"),
                )

            inner = geo.filter("child_count > 0").select("id", "parent_id", "level", "ord", "child_count")
            parents = [materialize(as_parents(inner.filter("level = 0").withColumns(at_root)), "line-0")]
            for d in range(1, seen["depth"]):
                parents.append(materialize(as_parents(placed(inner.filter(F.col("level") == d), parents[-1])), f"line-{d}"))
            below = placed(geo.filter("level > 0"), reduce(DataFrame.unionByName, parents))
            columns = [c for c in geo.columns if c != "ord"] + ["x", "y", "r"]
            whole = geo.filter("level = 0").withColumns(at_root).select(*columns).unionByName(below.select(*columns))
            _labelled[key] = materialize(whole, "line", keep=True)
    return _labelled[key]
