"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexivec import queries


def shown(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [shown(x) for x in v] if isinstance(v, (list, tuple)) else v


def duck(sf_dir, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns, rows = duck(sf_dir, queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(columns)
    mine = sorted(str([shown(r[c]) for c in names]) for r in got.collect())
    theirs = sorted(str([shown(r[columns.index(c)]) for c in names]) for r in rows)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
