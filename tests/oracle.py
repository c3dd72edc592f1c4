"""Run queries next to their comparison SQL and compare rows, names and types."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from ramify.plans.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def compare(con, df, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r)) for r in cur.fetchall()]
    have = [r.asDict() for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for name, dtype in df.dtypes:
        if _TYPES.get(dtype) != kinds[name]:
            return f"type of {name}: {dtype} != {kinds[name]}"
    cols = sorted(names)
    a = sorted((tuple(_plain(r[c]) for c in cols) for r in have), key=_key)
    b = sorted((tuple(_plain(r[c]) for c in cols) for r in want), key=_key)
    if len(a) != len(b):
        sa, sb = set(a), set(b)
        return f"rows {len(a)} != {len(b)}; only spark {list(sa - sb)[:3]} only sql {list(sb - sa)[:3]} cols {cols}"
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"{dict(zip(cols, x))} != {dict(zip(cols, y))}"
    return None


def main() -> None:
    import __spark_entry__ as e
    from ramify.session import build_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    con = connect(sf_dir)
    bad = 0
    oracles = e.oracle_sql()
    for name, fn in e.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                result = compare(con, df, oracles[name])
            else:
                result = None if df.count() > 0 else "no rows"
        except Exception as error:  # noqa: BLE001
            result = f"{type(error).__name__}: {str(error)[:700]}"
        bad += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
