"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from textlode.plans.oracle import SQL
from textlode.plans.queries import QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in answer.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship(spark, sf_dir):
    assert flagship(spark, sf_dir).count() == 10


def test_entry_module_works_without_the_optional_parts(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= entry.queries().keys() and set(SQL) <= entry.oracle_sql().keys()
