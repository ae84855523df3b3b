"""Centroid clustering with adaptive distance bounds (Drake and Hamerly, 2012), in exact integers.

Each vector carries an upper bound of the distance to its centroid, the lower bounds of its `bounds` next nearest centroids, and one
bound below which no other centroid lies. When centroids move, bounds move with them. A vector whose upper bound stays below all
lower ones keeps its centroid without a look at any; otherwise the exact distance to its own centroid is taken, then the
distances to as many of the next nearest as cannot be told from it, and only where the last bound gives way to all.
Bounds are floating point with a margin; whatever they cannot certify is decided by integers, so ties go to the smaller number.

A round is one pass over the staged vectors: it writes vectors with their bounds, and one row of sums per centroid and task, from
which the next centroids follow. A lost executor costs the tasks that it ran. Nothing is shuffled but those sums.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, small_batches, stage, unstage

#: Scaled components stay below this, so squared distances of up to 64 of them fit a long.
LIMIT = 1 << 26
#: Relative margin of the floating-point bounds.
MARGIN = 1e-9


def scaled(column: pa.Array, dimensions: int | None, scale: int, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, ends, components): floor(scale * x) of the vectors that have no null or non-finite component, are not null, have `dimensions`
    components (None: any number) and stay below the limit in absolute value. rows are their places, ends where each ends in components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = np.asarray(column.is_valid())
    sizes = np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64)
    flat = column.flatten()  # without what null lists may hide
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
        wrong = ~(np.abs(values) < limit)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(wrong)])
    good = known & (bad[ends] == bad[ends - sizes])
    if dimensions is not None:
        good &= sizes == dimensions
    rows = np.flatnonzero(good)
    return rows, np.cumsum(sizes[rows]), values[np.repeat(good, sizes)].astype(np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; vectors n x d, centroids k x d or n x k x d, all long."""
    if centroids.ndim == 2:
        return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return ((vectors[:, None, :] - centroids) ** 2).sum(axis=2)


class Bounds:
    """Centroid a, upper bound u, next nearest centroids near, their lower bounds low, and rest, a bound of all others; a row a vector."""

    def __init__(self, a: np.ndarray, u: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray):
        self.a, self.u, self.near, self.low, self.rest = a, u, near, low, rest

    @classmethod
    def fresh(cls, vectors: np.ndarray, centroids: np.ndarray, bounds: int) -> tuple[Bounds, np.ndarray]:
        """Bounds from a look at all centroids, and the exact squared distances to the nearest."""
        d = squared(vectors, centroids)
        order = np.argsort(d, axis=1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, axis=1))
        b = min(bounds, len(centroids) - 1)
        rest = root[:, b + 1] if b + 1 < len(centroids) else np.full(len(d), np.inf)
        a = order[:, 0]
        return cls(a, root[:, 0], order[:, 1 : b + 1], root[:, 1 : b + 1], rest), d[np.arange(len(d)), a]

    def moved(self, by: np.ndarray) -> None:
        """Widen the bounds by what the centroids have moved."""
        self.u = self.u + by[self.a]
        self.low = np.maximum(self.low - by[self.near], 0)
        self.rest = np.maximum(self.rest - by.max(), 0)

    def settle(self, vectors: np.ndarray, centroids: np.ndarray) -> tuple[int, int]:
        """Make every assignment right. Gives how many rows took a partial and how many a full look."""
        n, b = self.near.shape
        # least[:, z]: below it no centroid lies that is not among the first z of the next nearest
        least = np.minimum.accumulate(np.concatenate([self.low, self.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        safe = lambda u, low: u * (1 + MARGIN) + MARGIN < low * (1 - MARGIN)
        open_ = np.flatnonzero(~safe(self.u, least[:, 0]))
        if not len(open_):
            return 0, 0
        own = ((vectors[open_] - centroids[self.a[open_]]) ** 2).sum(axis=1)
        self.u[open_] = np.sqrt(own)
        sure = safe(self.u[open_][:, None], least[open_])
        need = np.where(sure.any(axis=1), sure.argmax(axis=1), b + 1)
        for z in range(1, b + 1):
            rows, mine = open_[need == z], own[need == z]
            if not len(rows):
                continue
            ids = np.concatenate([self.a[rows, None], self.near[rows, :z]], axis=1)
            d = np.concatenate([mine[:, None], squared(vectors[rows], centroids[ids[:, 1:]])], axis=1)
            order = np.lexsort((ids, d), axis=1)
            ids, root = np.take_along_axis(ids, order, axis=1), np.sqrt(np.take_along_axis(d, order, axis=1))
            self.a[rows], self.u[rows], self.near[rows, :z], self.low[rows, :z] = ids[:, 0], root[:, 0], ids[:, 1:], root[:, 1:]
        rows = open_[need > b]
        if len(rows):
            new, _ = Bounds.fresh(vectors[rows], centroids, b)
            self.a[rows], self.u[rows], self.near[rows], self.low[rows], self.rest[rows] = new.a, new.u, new.near, new.low, new.rest
        return int(((need > 0) & (need <= b)).sum()), len(rows)


def _sums(a: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((k, vectors.shape[1]), np.int64)
    for j in range(k):
        total[j] = vectors[a == j].sum(axis=0)
    return total, np.bincount(a, minlength=k)


#: A row is a vector (c null) or the sums of one centroid in one task (c its number).
_STATE = "id {id}, v binary, a int, u double, near binary, low binary, rest double, c int, count long, total array<bigint>"


def _rows(ids: pa.Array, vectors: np.ndarray, b: Bounds) -> dict[str, pa.Array]:
    cut = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary()) if x.shape[1] else pa.array([b""] * len(x), pa.binary())
    return {"id": ids, "v": cut(vectors.astype(np.int32)), "a": pa.array(b.a, pa.int32()), "u": pa.array(b.u), "near": cut(b.near.astype(np.int16)), "low": cut(b.low), "rest": pa.array(b.rest)}


def _batch(columns: dict[str, pa.Array], n: int, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(column), 0), kind)
    at, data = column.buffers()[1:]
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(column), width)


def _passes(read, centroids: np.ndarray, kind: pa.DataType):
    """An iterator function for mapInArrow: vectors with bounds, then the sums of the task. read: batch -> ids, vectors, bounds."""
    k, dims = centroids.shape
    text, number = pa.binary(), pa.int64()
    schema = pa.schema([("id", kind), ("v", text), ("a", pa.int32()), ("u", pa.float64()), ("near", text), ("low", text), ("rest", pa.float64()), ("c", pa.int32()), ("count", number), ("total", pa.list_(number))])

    def run(batches):
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            ids, vectors, bounds = read(batch)
            if not len(vectors):
                continue
            own, n = _sums(bounds.a, vectors, k)
            total, count = total + own, count + n
            yield _batch(_rows(ids, vectors, bounds), len(vectors), schema)
        if count.any():
            yield _batch({"c": pa.array(range(k), pa.int32()), "count": pa.array(count), "total": lists(list(total), number)}, k, schema)

    return run


def seeds(kept: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors of the least sha256 of ``salt:id``, in that order (equal hashes: by the vectors). kept: id, v."""
    first = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return np.array([np.frombuffer(r["v"], np.int32) for r in first.collect()], np.int64)


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: int = 3, bounds: int = 3, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly `dimensions` components that are neither null nor non-finite, with scaled components below 2**26 in absolute value, for
    squared distances must fit a long. Repeated rows are vectors of their own; so are rows without an id. With fewer kept vectors than k there are as many centroids
    as vectors. Without any there is no row. Equal centroids: the smaller number takes all. Columns beside id and vector are not read.
    What reaches the driver are k centroids and the k * dimensions sums of a round. A round that moves no centroid is the last, for the others would change nothing.
    """
    spark = df.sparkSession
    small_batches(spark)
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x"))

    def parse(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        keep, _, values = scaled(batch.column(1), dimensions, scale, LIMIT)
        return batch.column(0).take(pa.array(keep)), values.reshape(len(keep), dimensions)

    def vectors_only(batches):
        for batch in batches:
            ids, v = parse(batch)
            if len(v):
                yield pa.RecordBatch.from_arrays([ids, _matrix_out(v)], names=["id", "v"])

    def fresh(batch):
        ids, v = parse(batch)
        return ids, v, Bounds.fresh(v, centroids, bounds)[0] if len(v) else None

    centroids = seeds(rows.mapInArrow(vectors_only, f"id {kind}, v binary"), k, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    arrow_kind = _arrow(df, id)
    state = stage(rows.mapInArrow(_passes(fresh, centroids, arrow_kind), _STATE.format(id=kind)), "vectors")
    for _ in range(rounds):
        sums = state.where("c is not null").select("c", "count", F.posexplode("total").alias("p", "x")).groupBy("c", "p").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("count").alias("n"))
        old, centroids = centroids, centroids.copy()
        for r in sums.collect():
            if r["n"]:
                centroids[r["c"], r["p"]] = int(r["x"]) // r["n"]
        if (old == centroids).all():
            break
        before = state
        state = stage(state.where("c is null").select("id", "v", "a", "u", "near", "low", "rest").mapInArrow(_passes(_settler(old, centroids, bounds), centroids, arrow_kind), _STATE.format(id=kind)), "vectors")
        unstage(before)

    def measured(batches):
        for batch in batches:
            a, v = np.asarray(batch.column(2)), _matrix(batch.column(1), np.int32, dimensions).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(((v - centroids[a]) ** 2).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    found = state.where("c is null").select("id", "v", "a").mapInArrow(measured, f"vec_id {kind}, cluster int, distance long")
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    most = (1 << 63) - 1
    lines = [(j, min(inertia.get(j, 0), most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _matrix_out(v: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * v.shape[1]), len(v), [None, pa.py_buffer(v.astype(np.int32).tobytes())]).cast(pa.binary())


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _settler(old: np.ndarray, new: np.ndarray, bounds: int):
    """read of _passes for a later round: the bounds of a batch, moved with the centroids and settled."""
    by = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + MARGIN)
    b, dims = min(bounds, len(new) - 1), new.shape[1]

    def read(batch: pa.RecordBatch):
        ids, v, a, u, near, low, rest = batch.columns
        vectors = _matrix(v, np.int32, dims).astype(np.int64)
        state = Bounds(np.array(a, np.int64), np.array(u), _matrix(near, np.int16, b).astype(np.int64), _matrix(low, np.float64, b).copy(), np.array(rest))
        state.moved(by)
        state.settle(vectors, new)
        return ids, vectors, state

    return read


def sql(k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: int = 3) -> str:
    """The same in DuckDB: a chain of rounds, each written out."""
    distance = "list_sum(list_transform(range(1, {d} + 1), lambda i: (v[i] - w[i]) * (v[i] - w[i])))::BIGINT".format(d=dimensions)
    nearest = "SELECT vec_id, nr, v, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT x.vec_id, x.nr, x.v, m.c, {d} AS d FROM x, {m} m) GROUP BY vec_id, nr, v"
    out = f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dimensions}),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS c, v AS w FROM x ORDER BY sha256('{salt}:' || vec_id) LIMIT {k})"""
    for r in range(rounds):
        out += f""",
a{r} AS MATERIALIZED ({nearest.format(d=distance, m=f"m{r}")}),
s{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) AS e(i) GROUP BY c, i),
m{r + 1} AS MATERIALIZED (SELECT m.c, coalesce(q.w, m.w) AS w FROM m{r} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM s{r} GROUP BY c) q USING (c))"""
    return out + f""",
a AS MATERIALIZED ({nearest.format(d=distance, m=f"m{rounds}")})
SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a JOIN m{rounds} USING (c)"""
