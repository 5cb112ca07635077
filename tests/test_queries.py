"""Every query that SQL can say agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from docspark.plans import catalog, sql


def rows(frame):
    def norm(v):
        return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v

    return sorted(str([norm(v) for v in r]) for r in frame)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    want = duck.execute(sql.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(map(tuple, got.select(*columns).collect())) == rows(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(sql.ORACLES)))
def test_others_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
