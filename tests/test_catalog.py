import os
import re

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = set(entry.queries()) - set(entry.oracle_sql())
    assert [name for name in rows_only if not re.match(r"op\d+_|pipeline$", name)] == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "name", "level", "leaf_count", "path"] and df.count() == 31


@pytest.mark.parametrize("name", ["interval_labels", "search", "orphans", "shard_key", "valid_rows", "event_rate"])
def test_query_matches_sql(spark, name):
    assert compare(connect(SF), entry.queries()[name](spark, SF), entry.oracle_sql()[name]) is None


def test_comparison_sees_differences(spark):
    con = connect(SF)
    df = spark.sql("SELECT cast(1 AS bigint) AS a, 'x' AS b")
    assert compare(con, df, "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b") is None
    assert compare(con, df, "SELECT CAST(2 AS BIGINT) AS a, 'x' AS b")
    assert compare(con, df, "SELECT 1 AS a, 'x' AS b")
    assert compare(con, df, "SELECT CAST(1 AS BIGINT) AS c, 'x' AS b")
    assert compare(con, df, "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b WHERE false")
