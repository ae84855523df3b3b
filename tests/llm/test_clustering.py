from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lexspark.llm import clustering

SCHEMA = "vec_id long, embedding array<double>"


def plainly(rows, k=8, rounds=10, dimensions=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    means = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], np.int32).tobytes()))[:k]]
    far = lambda v, w: sum((x - y) ** 2 for x, y in zip(v, w, strict=True))
    nearest = lambda v: min(range(len(means)), key=lambda c: (far(v, means[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        means = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if c in groups else w for c, w in enumerate(means)]
    out = [(i, nearest(v), far(v, means[nearest(v)])) for i, v in kept]
    own = {c: sum(d for _, b, d in out if b == c) for c in range(len(means))}
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest()) for i, c, d in out]


def result(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


def blobs(seed, n, dimensions=64, centres=12):
    draw = random.Random(seed)
    where = [[draw.uniform(-0.3, 0.3) for _ in range(dimensions)] for _ in range(centres)]
    return [(i, [x + draw.gauss(0, 0.08) for x in draw.choice(where)]) for i in range(n)]


def test_clusters_equal_the_definition_and_awkward_rows_take_no_part(spark):
    rows = blobs(1, 300)
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [None] + [0.1] * 63), (1005, [math.nan] + [0.1] * 63), (1006, [math.inf] * 64), (7, [0.1] * 64), (None, [0.2] * 64), (1007, [-0.0] * 64)]
    rows += [(2000 + i, rows[5][1]) for i in range(60)] + [(5, rows[5][1])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", cluster int, id string")
    assert result(clustering.cluster(df)) == sorted(plainly(rows), key=str)


@pytest.mark.parametrize("k, dimensions, bounds", [(1, 64, 3), (2, 3, 3), (5, 2, 1), (8, 1, 2), (20, 4, 3)])
def test_ties_and_other_parameters(spark, k, dimensions, bounds):
    draw = random.Random(k)
    rows = [(i, [draw.randrange(-3, 4) / 1024 for _ in range(dimensions)]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(clustering.cluster(df, k, 6, dimensions, bounds=bounds)) == sorted(plainly(rows, k, 6, dimensions), key=str)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = blobs(3, 5)
    assert result(clustering.cluster(spark.createDataFrame(rows, SCHEMA))) == sorted(plainly(rows), key=str)
    assert clustering.cluster(spark.createDataFrame([(1, None), (2, [1.0])], SCHEMA)).collect() == []
    assert clustering.cluster(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bounds_spare_most_looks_and_never_err():
    draw = np.random.default_rng(4)
    vectors = (draw.normal(0, 60, (4000, 16)) + draw.integers(-400, 400, (20, 16))[draw.integers(0, 20, 4000)]).astype(np.int64)
    centroids = vectors[:20].copy()
    state, _ = clustering.Bounds.fresh(vectors, centroids, 3)
    looks = []
    for _ in range(12):
        old, centroids = centroids, centroids.copy()
        for c in set(state.a.tolist()):
            centroids[c] = vectors[state.a == c].sum(axis=0) // (state.a == c).sum()
        state.moved(np.sqrt(((centroids - old) ** 2).sum(axis=1)) * (1 + clustering.MARGIN))
        looks.append(state.settle(vectors, centroids))
        assert (state.a == clustering.squared(vectors, centroids).argmin(axis=1)).all()
    assert looks[-1][1] < 400  # of 4,000 vectors


def test_the_table_in_whole_equals_its_sql(spark, sf_dir):
    from lexspark.llm.queries import op11_drake_clustering

    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
        want = sorted(db.execute(clustering.sql()).fetchall(), key=str)
    assert result(op11_drake_clustering(spark, sf_dir)) == want
