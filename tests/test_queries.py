"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from confab.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, name, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    want = r.fetchall()
    df = query(spark, SF)
    assert sorted(df.columns) == sorted(names)
    show = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in row)) for row in rows)
    assert show(df.select(*names).collect()) == show(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name])


def test_entry_has_the_flagship():
    assert "meeting_metrics" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
