"""Nearest vectors by random-hyperplane buckets (Charikar, 2002), re-ranked exactly.

A vector's bucket in a table is the side on which it lies of each of `bits` random planes. Vectors at a small angle share buckets, so a query meets the
vectors of its own bucket and of the `probes` buckets beyond the planes that it lies nearest to, in all tables. What it meets is ranked by the exact cosine. The planes
follow from a seed, so an index may be kept as a table and read again. More bits make smaller buckets, more tables or probes
raise the recall; `recall` measures it against all pairs. `exact_nearest` looks at all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.staging import arrow


@dataclass(frozen=True)
class Planes:
    """How vectors are put into buckets. The defaults find nine of ten neighbours even at a cosine of 0.25, at the price of meeting most of an unclustered table."""

    dimensions: int
    bits: int = 8
    tables: int = 32
    probes: int = 8
    seed: int = 7

    def __post_init__(self):
        if not 1 <= self.bits <= 32 or self.tables < 1 or not 0 <= self.probes <= self.bits:
            raise ValueError("bits are 1 to 32, tables one or more, probes none to bits")

    def _sides(self, vectors: np.ndarray) -> np.ndarray:
        """rows x tables x bits: the products with the planes."""
        planes = np.random.default_rng(self.seed).normal(size=(self.dimensions, self.tables * self.bits))
        return (vectors @ planes).reshape(len(vectors), self.tables, self.bits)

    def keys(self, vectors: np.ndarray, probe: bool) -> np.ndarray:
        """rows x buckets: the bucket of each table, with probe those near by as well; a bucket's number names its table."""
        sides = self._sides(vectors)
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        own = (sides > 0) @ weights + (np.arange(self.tables, dtype=np.int64) << self.bits)
        if not probe or not self.probes:
            return own
        near = np.argsort(np.abs(sides), axis=2)[:, :, : self.probes]
        return np.concatenate([own[:, :, None], own[:, :, None] ^ weights[near]], axis=2).reshape(len(vectors), -1)


def buckets(vector: Column, planes: Planes, probe: bool = False) -> Column:
    """The buckets of a vector, an array of longs; of one that is null or not of the planes' dimension none."""

    @arrow("array<bigint>")
    def run(vectors: pa.Array) -> pa.Array:
        rows = vectors.to_pylist()
        good = [i for i, v in enumerate(rows) if v is not None and len(v) == planes.dimensions and None not in v]
        out: list = [[] for _ in rows]
        if good:
            for i, keys in zip(good, planes.keys(np.array([rows[i] for i in good], np.float64), probe).tolist(), strict=True):
                out[i] = keys
        return pa.array(out, pa.list_(pa.int64()))

    return run(vector)


def hyperplane_index(df: DataFrame, planes: Planes, id: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """(bucket, vector, ids): each distinct vector in each of its buckets, with the least `most` ids that bear it: a search for k rows needs no more
    than k + 1. A vector that many rows bear is one row of a bucket. Rows without an id are left out."""
    least = Window.partitionBy("vector").orderBy("id")
    rows = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("vector")).withColumn("r", F.row_number().over(least)).where(F.col("r") <= most)
    own = rows.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return own.select("vector", "ids", F.explode(buckets(F.col("vector"), planes)).alias("bucket"))


def nearest_in(index: DataFrame, queries: DataFrame, planes: Planes, k: int = 10, id: str = "vec_id", vector: str = "embedding", digits: int = 6, parts: int = 1) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of what each query meets in the index, its own id left out; ties to the smaller id. k is below the ids that an
    index row holds. A query that meets fewer rows has fewer results. Each task takes a table's buckets, or one of `parts` parts of their rows, and 4,096 queries; it compares
    the queries of a bucket with its rows by products of matrices of limited size, and gives the best of each query."""
    asked = queries.where(F.col(id).isNotNull()).select(F.col(id).alias("query_id"), F.col(vector).alias("q"))
    blocks = -(-asked.count() // 4096) or 1
    near = asked.withColumn("keys", buckets(F.col("q"), planes, True)).select("query_id", "q", F.explode(_by_table(F.col("keys"), planes)).alias("near"))
    near = near.withColumns({"t": F.shiftright(F.get("near", F.lit(0)), planes.bits).cast("int"), "p": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "b": _part("query_id", blocks)})
    rows = index.withColumns({"t": F.shiftright("bucket", planes.bits).cast("int"), "p": _part("vector", parts), "b": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})

    def best_of(asked: pa.Table, rows: pa.Table) -> pa.Table:
        q, v = Rows.of(asked["q"]), Rows.of(rows["vector"])
        ids = rows["ids"].combine_chunks()
        ids = ids.cast(pa.list_(ids.type.value_type))  # items that may be null, as the result's type has them
        code = np.unique(pc.list_element(ids, 0).to_numpy(zero_copy_only=False), return_inverse=True)[1]
        own = rows["bucket"].to_numpy()
        order = np.argsort(own, kind="stable")
        own = own[order]
        probes = asked["near"].combine_chunks()
        meets, who = probes.flatten().to_numpy(), np.repeat(np.arange(len(q)), pc.list_value_length(probes).to_numpy())
        by = np.argsort(meets, kind="stable")
        meets, who = meets[by], who[by]
        found = [_NONE]
        for bucket in np.intersect1d(own, meets):
            some = order[np.searchsorted(own, bucket) : np.searchsorted(own, bucket, "right")]
            askers = who[np.searchsorted(meets, bucket) : np.searchsorted(meets, bucket, "right")]
            i, j, score, none = _best(q[askers], v[some], code[some], k + 1, digits)
            found.append((askers[i], some[j], score, none))
        # a vector is in one bucket of a table; those before it in the order have k + 1 ids, of which one may be the query's own
        i, j, score, none = _first(*map(np.concatenate, zip(*found, strict=True)), code, k + 1, digits)
        return pa.table({"query_id": asked["query_id"].take(i), "ids": ids.take(pa.array(j)), "score": pa.array(score, mask=none)})

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, ids {index.schema['ids'].dataType.simpleString()}, score double"
    met = near.groupBy("t", "p", "b").cogroup(rows.groupBy("t", "p", "b")).applyInArrow(best_of, kinds).withColumn("score", F.round("score", digits))
    # each row of the index once a query: equal ids are of one vector, so of one score
    each = met.select("query_id", "score", F.explode(F.slice("ids", 1, k + 1)).alias("id")).where("id <> query_id").dropDuplicates(["query_id", "id"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def exact_nearest(df: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", digits: int = 6, block: int = 512, rows: int = 8192) -> DataFrame:
    """The same by all pairs: queries in blocks of about `block` meet all rows in blocks of about `rows`; each pair of blocks is a product of matrices that gives
    the best k of each query. Pairs are as many as queries by rows; what is shuffled is each row once a block of queries and each query once a block of rows."""
    asked = queries.where(F.col(id).isNotNull()).select(F.col(id).alias("query_id"), F.col(vector).alias("q"))
    every = df.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v"))
    n_asked, n_every = -(-asked.count() // block) or 1, -(-every.count() // rows) or 1
    left = asked.withColumns({"b": _part("query_id", n_asked), "r": F.explode(F.sequence(F.lit(0), F.lit(n_every - 1)))})
    right = every.withColumns({"r": _part("id", n_every), "b": F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))})

    def best_of(asked: pa.Table, every: pa.Table) -> pa.Table:
        both = np.unique(np.concatenate([asked["query_id"].to_numpy(), every["id"].to_numpy()]), return_inverse=True)[1]
        i, j, score, none = _best(Rows.of(asked["q"]), Rows.of(every["v"]), both[len(asked) :], k, digits, both[: len(asked)])
        return pa.table({"query_id": asked["query_id"].take(i), "id": every["id"].take(j), "score": pa.array(score, mask=none)})

    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {every.schema['id'].dataType.simpleString()}, score double"
    scored = left.groupBy("b", "r").cogroup(right.groupBy("b", "r")).applyInArrow(best_of, kinds).withColumn("score", F.round("score", digits))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _part(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _by_table(keys: Column, planes: Planes) -> Column:
    """The buckets that a query meets as one array for each table; keys() gives as many for every table, one after the other."""
    each = planes.probes + 1
    return F.when(F.size(keys) > 0, F.transform(F.sequence(F.lit(0), F.lit(planes.tables - 1)), lambda t: F.slice(keys, t * each + 1, F.lit(each))))


#: No pairs: places of queries and rows, scores, and where a score is null.
_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
#: Pairs of a query and a row that are compared at a time.
_PAIRS = 1 << 20


@dataclass(frozen=True)
class Rows:
    """Vectors side by side, as columns; one that is null or holds a null has size -1 and length 0. Sums go by component as in vectors.dot, so they are the same."""

    columns: np.ndarray
    size: np.ndarray
    length: np.ndarray

    @staticmethod
    def of(vectors: pa.ChunkedArray) -> Rows:
        lists = vectors.combine_chunks()
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        filled = np.arange(sizes.max(initial=0)) < sizes[:, None]
        out, gaps = np.zeros(filled.shape), np.zeros(filled.shape, bool)
        out[filled] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        gaps[filled] = flat.is_null().to_numpy(zero_copy_only=False)
        bad = lists.is_null().to_numpy(zero_copy_only=False) | gaps.any(axis=1)
        columns, squares = np.ascontiguousarray(out.T), np.zeros(len(sizes))
        with np.errstate(all="ignore"):
            for x in columns:
                squares += x * x
        return Rows(columns, np.where(bad, -1, sizes), np.where(bad, 0.0, np.sqrt(squares)))

    def __len__(self) -> int:
        return len(self.size)

    def __getitem__(self, places) -> Rows:
        return Rows(self.columns[:, places], self.size[places], self.length[places])


def _cosines(dots: np.ndarray, lengths: np.ndarray, alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """vectors.cosine of products, and where it is null: for vectors of two sizes."""
    some = (lengths > 0) | np.isnan(lengths)
    return np.where(some, dots / lengths, 0.0), some & ~alike


def _key(scores: np.ndarray, none: np.ndarray) -> np.ndarray:
    """What scores are ordered by, the greatest first: NaN before all numbers, null after them."""
    return np.where(none, -np.inf, np.where(np.isnan(scores), np.inf, scores))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x in units of its last digit, halves away from zero, as the engine rounds; near a half by its decimal digits."""
    units = np.abs(x) * 10.0**digits
    out = np.floor(units + 0.5)
    for i in np.nonzero(np.abs(units - np.floor(units) - 0.5) < 1e-4)[0]:
        out[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(x), x, np.copysign(out, x))


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, none: np.ndarray, code: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, ...]:
    """Of pairs of a query i and a row j each query's first k by the rounded score, then by the row's code."""
    order = np.lexsort((code[j], -_key(_rounded(score, digits), none), i))
    i = i[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[order][kept], score[order][kept], none[order][kept]


@np.errstate(all="ignore")
def _best(q: Rows, v: Rows, code: np.ndarray, k: int, digits: int, own: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, row, score, null) of each query's first k rows; own: rows of this code are left out for the query. Products of matrices rule out what lies below the
    k-th by more than rounding can make good; the rest is summed anew, component by component."""
    out, d, step = [_NONE], min(len(q.columns), len(v.columns)), max(1, _PAIRS // max(1, len(v)))
    for lo in range(0, len(q) if len(v) else 0, step):
        some = q[slice(lo, lo + step)]
        near = _key(*_cosines(some.columns[:d].T @ v.columns[:d], some.length[:, None] * v.length, some.size[:, None] == v.size))
        allowed = np.ones(near.shape, bool) if own is None else own[lo : lo + step, None] != code
        if len(v) > k:
            least = np.partition(np.where(allowed, near, -np.inf), len(v) - k, axis=1)[:, len(v) - k]
            allowed &= near >= (least - 2 * 10.0**-digits)[:, None]
        i, j = np.nonzero(allowed)
        dots = np.zeros(len(i))
        for a, b in zip(some.columns, v.columns, strict=False):
            dots += a[i] * b[j]
        score, none = _cosines(dots, some.length[i] * v.length[j], some.size[i] == v.size[j])
        i, j, score, none = _first(i, j, score, none, code, k, digits)
        out.append((i + lo, j, score, none))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, found): how many of a query's exact neighbours were found; equal scores count as found, whichever of them was."""
    last = exact.groupBy("query_id").agg(F.count("*").alias("wanted"), F.min("score").alias("least"))
    hits = found.join(last, "query_id").where(F.col("score") >= F.col("least")).groupBy("query_id").agg(F.count("*").alias("hits"))
    return last.join(hits, "query_id", "left").select("query_id", "wanted", F.least("wanted", F.coalesce("hits", F.lit(0))).alias("found"))
