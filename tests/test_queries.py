"""Every query that has SQL gives DuckDB's rows; every other one runs."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__
from lexspark.plans import oracles, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            c.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        yield c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, bool):
        return x
    if isinstance(x, int):
        return float(x)
    return str(x)[:10] if isinstance(x, datetime.date) else x


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = oracles.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(map(plain, r)) for r in found.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_entry(spark, sf_dir):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
