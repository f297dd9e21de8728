"""Every registered query against its SQL in an independent engine, on the smallest tables."""

import math

import duckdb
import pytest

from quietsignal.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    at = [found.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
