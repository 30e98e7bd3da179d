"""Every registered query with SQL gives the same rows in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(list(v.asDict().values()))
    if isinstance(v, dict):
        return plain(list(v.values()))
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{Path(sf_dir) / t}.parquet')")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    assert len(got) == len(want), (len(got), len(want))
    different = [(g, w) for g, w in zip(got, want) if g != w]
    assert not different, different[:3]


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and not n.startswith("op") and n != "pipeline"])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect() is not None


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
