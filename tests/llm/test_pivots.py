from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from lexspark.llm import pivots

from .test_clustering import SCHEMA, blobs


def plainly(rows, step=50, top=5):
    kept = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    trim = lambda v: v[: max((j + 1 for j, x in enumerate(v) if x), default=0)]
    kept, out = {(i, trim(v)) for i, v in kept}, []
    for i, q in kept:
        if i % step == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in kept if (j, v) != (i, q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:top], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_products_equal_all_pairs_and_awkward_rows_take_no_part(spark):
    rows = blobs(1, 400, 16)
    rows += [(450, None), (451, []), (500, []), (452, [math.nan] * 16), (550, [math.inf]), (551, [None, 1.0]), (None, [0.1] * 16), (600, [0.5] * 20), (601, [0.5] * 3), (650, [-1.0] * 16)]
    rows += [(1000 + i, rows[5][1]) for i in range(130)] + [rows[50], rows[50]]  # a vector of many rows, and rows that stand again
    rows += [(100, [0.3] * 16)]  # an id of two vectors
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", rank int, v string")
    assert result(pivots.top_products(df)) == plainly(rows)


@pytest.mark.parametrize("few", [0, 1, 2, 4])
def test_few_rows(spark, few):
    rows = [(50 * i, [0.1 * i, 1.0]) for i in range(few)]
    assert result(pivots.top_products(spark.createDataFrame(rows, SCHEMA))) == plainly(rows)


def test_small_integers_full_of_ties(spark):
    draw = random.Random(5)
    rows = [(i, [draw.randrange(-2, 3) / 256 for _ in range(3)]) for i in range(300)]
    assert result(pivots.top_products(spark.createDataFrame(rows, SCHEMA), "vec_id % 10 = 0", pivots=7)) == plainly(rows, 10)


def test_bounds_rule_out_candidates_and_never_the_best():
    draw = np.random.default_rng(6)
    v = (draw.normal(0, 4, (1500, 24)) + draw.normal(0, 60, (12, 24))[draw.integers(0, 12, 1500)]).astype(np.int64)
    table = pivots.choose_pivots(v[:500], 16)
    d = pivots.distances(v, table)
    block = pivots.Block(v, d, np.arange(1500), np.arange(1501))
    looked = 0
    for i in range(0, 1500, 30):
        best, seen = pivots.search(v[i], d[i], float("-inf"), block, 6)
        looked += seen
        assert best.scores.tolist() == sorted((v @ v[i]).tolist(), reverse=True)[:6]
    assert looked < 50 * 1500 / 2


def test_products_are_exact_in_whatever_form():
    draw = np.random.default_rng(8)
    for most in (9, 3000, 10**6, 2**28 - 1):
        v = draw.integers(-most, most + 1, (300, 8)).astype(np.int64)
        block = pivots.Block(v, np.zeros((300, 1)), np.arange(300), np.arange(301))
        for rows in (np.arange(300), np.arange(0, 300, 7)):
            assert block.products(v[3], rows).tolist() == [sum(int(a) * int(b) for a, b in zip(v[3], v[i], strict=True)) for i in rows]


def test_the_table_in_whole_equals_its_sql(spark, sf_dir):
    from lexspark.llm.queries import op13_pivot_top_products

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        want = sorted(db.execute(pivots.sql()).fetchall())
    assert result(op13_pivot_top_products(spark, sf_dir)) == want
