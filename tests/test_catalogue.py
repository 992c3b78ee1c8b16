"""Every catalogue query against its oracle SQL on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, small, duck, name):
    got = catalogue.QUERIES[name](spark, small)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [list(want.columns).index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_oracle(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
