"""Equi-joins whose left side may share few keys, or one key in very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.store import materialize

FEW_KEYS = 50_000  # keys whose rows are broadcast
SHARED_BY = 100_000  # rows of one key that are not sent to one task


def join_shared(rows: DataFrame, table: DataFrame, key: str, how: str = "left", few: int = FEW_KEYS) -> DataFrame:
    """``rows`` joined (left or inner) with ``table`` on ``key``, whatever the number of rows per key.

    The keys of ``rows`` are counted first. If they are at most ``few``, their rows of ``table``
    are broadcast and ``rows`` stay where they are. Otherwise that holds for the keys which
    more than SHARED_BY rows share, so that no task gets all rows of one; the others are
    joined by a shuffle. Rows without a key meet nothing and do not move. Both sides are
    read twice or more: stored tables, as a rule. ``table`` may repeat keys, but few times.
    """
    counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    keys, seen = materialize(counted, f"keys-{key}", {"keys": F.count(F.lit(1)), "most": F.max("_rows")})
    keyed = rows.filter(F.col(key).isNotNull())

    def sent(some: DataFrame) -> DataFrame:
        return F.broadcast(table.join(F.broadcast(some.select(key)), key, "left_semi"))

    if seen["keys"] <= few:
        found = keyed.join(sent(keys), key, how)
    elif (seen["most"] or 0) <= SHARED_BY:
        found = keyed.join(table.join(keys.select(key), key, "left_semi"), key, how)
    else:
        shared = keys.filter(F.col("_rows") > SHARED_BY)
        rest = keyed.join(F.broadcast(shared.select(key)), key, "left_anti")
        found = rest.join(table, key, how).unionByName(keyed.join(F.broadcast(shared.select(key)), key, "left_semi").join(sent(shared), key, how))
    return found if how == "inner" else found.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)
