"""Every query that has SQL gives the same rows as DuckDB over the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

from loomspark.plans import collect

QUERIES, SQL = collect()


def plain(v):
    if isinstance(v, float | decimal.Decimal) and not isinstance(v, bool):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(rs):
    return sorted((tuple(map(plain, r)) for r in rs), key=repr)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    if name not in SQL:
        return
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({SQL[name]})").fetchall()
    assert got == rows(want)


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)
