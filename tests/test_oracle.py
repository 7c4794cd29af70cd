"""Every registered raster query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from rasterel.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in registry.oracle_sql():
        found = duck.sql(registry.oracle_sql()[name])
        rows = [dict(zip(found.columns, r)) for r in found.fetchall()]
        assert sorted(found.columns) == columns
        assert got == sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
