"""Exact top-k search by inner product with a table of distances to pivots (LAESA, Mico, Oncina and Vidal, 1994).

<q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2, and every pivot p gives |q - x| >= ||q - p| - |x - p||. So the table of distances from each
vector to PIVOTS pivots gives each candidate an upper bound of its score. Candidates are looked at in the order of their bounds, and
the search of a query stops where the next bound falls below the k-th best score so far: no other candidate can reach it.

Equal vectors are one candidate that knows its smallest ids, as many as can ever be among the best, and one query, so a vector that a third of all
rows hold is one row. Candidates lie in cells (the nearest pivot), sorted by range over many tasks within them and cut into blocks of at most BLOCK vectors,
each with the range of its distances to all pivots. Queries lie in chunks. Chunks first meet the blocks of their own cells, which sets a score to beat;
then those of other cells whose bounds, held for PIVOTS cells on the driver, do not rule them out; a block is ruled out
whole before its candidates are. Nothing that grows with the data is broadcast or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clustering import scaled
from .common import lists, small_batches, stage, unstage

#: Pivots, and the vectors, at most, of which they are chosen.
PIVOTS, SAMPLE = 32, 2048
#: Vectors of a block and of a chunk of queries at most; candidates looked at before the first test for the end.
BLOCK, CHUNK, STEP = 2048, 256, 64
#: Scaled components stay below this, so products of up to 128 of them fit a long.
LIMIT = 1 << 28
#: Relative margin of floating-point distances.
MARGIN = 1e-6


def _packed(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of long, filled up with zeros to `dims`."""
    out = np.zeros((len(column), dims), np.int64)
    for i, raw in enumerate(column.to_pylist()):
        v = np.frombuffer(raw, np.int32)
        out[i, : len(v)] = v
    return out


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p).astype(np.float64) ** 2).sum(axis=1)) for p in pivots], axis=1)


def ceilings(norms: np.ndarray, least: np.ndarray, of: float) -> np.ndarray:
    """Upper bounds of scores from squared norms and lower bounds of distances, with a margin; of: squared norm of the query."""
    reach = np.maximum(least * (1 - MARGIN), 0)
    return (of + norms - reach * reach) / 2 + MARGIN * (of + norms) + 1


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest first: each pivot is the vector of the sample that lies farthest from those before it. The first lies farthest from the mean."""
    if not len(sample):
        return sample
    first = int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())
    chosen, near = [first], distances(sample, sample[[first]])[:, 0]
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[[chosen[-1]]])[:, 0])
    return sample[chosen]


class Best:
    """The `top` best (score, id) of a query so far, ties to the smaller id; least: the score to beat."""

    def __init__(self, top: int, least: float):
        self.top, self.least, self.scores, self.ids = top, least, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(self.least, float(self.scores[-1]))


class Block:
    """Candidates v (rows of long) with their distances d to the pivots; candidate i bears the ids from ends[i] to ends[i + 1]."""

    def __init__(self, v: np.ndarray, d: np.ndarray, ids: np.ndarray, ends: np.ndarray):
        self.v, self.ids, self.ends = v, ids, ends
        self.norm = (v.astype(np.float64) ** 2).sum(axis=1)
        self.apart = np.ascontiguousarray(d.T)  # pivots x candidates
        self.lo, self.hi = d.min(axis=0), d.max(axis=0)
        self.most = int(np.abs(v).max(initial=0))
        self.forms: dict[type, np.ndarray] = {}

    def products(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products with some candidates: in floating point where all sums are integers that it holds."""
        top = self.most * int(np.abs(q).max(initial=0)) * len(q)
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        if kind not in self.forms:
            self.forms[kind] = self.v.astype(kind)
        v, q = self.forms[kind], q.astype(kind)
        return ((v @ q)[rows] if 2 * len(rows) > len(v) else v[rows] @ q).astype(np.int64)


def search(q: np.ndarray, to_pivots: np.ndarray, least: float, block: Block, top: int) -> tuple[Best, int]:
    """The best of a block for one query, and how many candidates were looked at: in the order of their bounds, four times as many from step to step."""
    best, of = Best(top, least), float((q.astype(np.float64) ** 2).sum())
    apart = np.maximum(block.lo - to_pivots, to_pivots - block.hi).max(initial=0.0)
    if ceilings(block.norm.max(), np.float64(apart), of) < best.least:
        return best, 0
    bound = ceilings(block.norm, np.abs(block.apart - to_pivots[:, None]).max(axis=0), of)
    order = np.argsort(-bound)
    falling, at, size = -bound[order], 0, STEP
    while at < len(order):
        rows = order[at : min(at + size, int(np.searchsorted(falling, -best.least, side="right")))]
        if not len(rows):
            break
        scores = block.products(q, rows)
        at, size = at + len(rows), 4 * size
        rows, scores = rows[good := scores >= best.least], scores[good]
        counts = block.ends[rows + 1] - block.ends[rows]
        first = np.repeat(block.ends[rows] - np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64), counts)
        best.add(np.repeat(scores, counts), block.ids[first + np.arange(len(first))])
    return best, at


def _vectors(df: DataFrame, scale: int, id: str, vector: str) -> DataFrame:
    """(vec_id, v, n): each row once, scaled, without zeros at the end, and its product with itself; vectors and ids that take no part are left out."""
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).where("vec_id is not null")

    def parse(batches):
        for batch in batches:
            keep, ends, values = scaled(batch.column(1), None, scale, LIMIT)
            starts = np.concatenate([[0], ends])
            v = [np.trim_zeros(values[a:b], "b") for a, b in zip(starts[:-1], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([x.astype(np.int32).tobytes() for x in v], pa.binary()), pa.array([int(x @ x) for x in v], pa.int64())], names=["vec_id", "v", "n"])

    return rows.mapInArrow(parse, "vec_id long, v binary, n long").dropDuplicates()


def _placed(pivots: np.ndarray, dims: int):
    """For mapInArrow: the cell of each vector, its distance to the cell's pivot, and its distances to all pivots; other columns stay."""

    def run(batches):
        for batch in batches:
            d = distances(_packed(batch.column("v"), dims), pivots)
            cell = d.argmin(axis=1)
            more = [pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell]), _binaries(d)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "own", "d"])

    return run


def _cut(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of one cell and at most `most` rows."""
    rest: pa.Table | None = None
    for batch in rows:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        while table.num_rows:
            cells = np.asarray(table.column("cell"))
            end = min(int((cells == cells[0]).sum()), most)
            if end == table.num_rows and end < most:
                break
            yield table.slice(0, end)
            table = table.slice(end)
        rest = table if table.num_rows else None
    if rest is not None:
        yield rest


_BLOCKS = "cell int, v binary, d binary, ids array<long>, ends array<int>, lo array<double>, hi array<double>, norm double, rows int"


def _blocks(dims: int, pivots: int):
    """For mapInArrow over (v, ids, cell, own, d), sorted by cell: one row a block."""

    def run(batches):
        for table in _cut(batches, BLOCK):
            v = _packed(table.column("v").combine_chunks(), dims)
            d = np.frombuffer(b"".join(table.column("d").to_pylist()), np.float64).reshape(-1, pivots)
            ids = table.column("ids").to_pylist()
            norm = (v.astype(np.float64) ** 2).sum(axis=1)
            ends = np.cumsum([0, *map(len, ids)])
            columns = [pa.array([int(table.column("cell")[0].as_py())], pa.int32()), pa.array([v.astype(np.int32).tobytes()]), pa.array([d.tobytes()]), lists([np.array([i for x in ids for i in x], np.int64)], pa.int64()), lists([ends.astype(np.int32)], pa.int32()), lists([d.min(axis=0)], pa.float64()), lists([d.max(axis=0)], pa.float64()), pa.array([norm.max()]), pa.array([len(v)], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "v", "d", "ids", "ends", "lo", "hi", "norm", "rows"])

    return run


def _pairs(dims: int, pivots: int, top: int):
    """For mapInArrow over chunks of queries joined with blocks: (v, vec_id, score), at most `top` for each query and block."""

    def run(batches):
        for batch in batches:
            out_v, out_id, out_score = [], [], []
            for row in batch.to_pylist():
                block = Block(np.frombuffer(row["v"], np.int32).reshape(-1, dims).astype(np.int64), np.frombuffer(row["d"], np.float64).reshape(-1, pivots), np.array(row["ids"], np.int64), np.array(row["ends"], np.int64))
                queries = np.frombuffer(row["q"], np.int32).reshape(-1, dims)
                to = np.frombuffer(row["qd"], np.float64).reshape(-1, pivots)
                for q, d, least in zip(queries, to, row["least"], strict=True):
                    best, _ = search(q.astype(np.int64), d, least, block, top)
                    keep = best.scores >= least
                    out_v += [np.trim_zeros(q, "b").tobytes()] * int(keep.sum())
                    out_id.append(best.ids[keep])
                    out_score.append(best.scores[keep])
            flat = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out_v, pa.binary()), flat(out_id), flat(out_score)], names=["v", "vec_id", "score"])

    return run


_CHUNKS = "cell int, q binary, qd binary, least array<double>"


def _chunks(dims: int, pivots: int, reach: dict[int, tuple[np.ndarray, np.ndarray, float]] | None):
    """For mapInArrow over queries (v, cell, own, d, least), sorted by cell: chunks, dealt to their own cell (reach None) or to the other
    cells that their bounds do not rule out. reach: cell -> least and greatest distances to the pivots, greatest squared norm."""

    def run(batches):
        for table in _cut(batches, CHUNK):
            v, home = _packed(table.column("v").combine_chunks(), dims), int(table.column("cell")[0].as_py())
            d = np.frombuffer(b"".join(table.column("d").to_pylist()), np.float64).reshape(-1, pivots)
            least = np.array(table.column("least").to_pylist(), np.float64)
            own, out = (v.astype(np.float64) ** 2).sum(axis=1), []
            if reach is None:
                out.append((home, np.arange(len(v))))
            else:
                for cell, (lo, hi, norm) in reach.items():
                    if cell != home:
                        apart = np.maximum(np.maximum(lo - d, d - hi).max(axis=1), 0)
                        out.append((cell, np.flatnonzero(ceilings(np.full(len(v), norm), apart, own) >= least)))
            out = [(c, rows) for c, rows in out if len(rows)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int32()), pa.array([v[r].astype(np.int32).tobytes() for _, r in out]), pa.array([d[r].tobytes() for _, r in out]), lists([least[r] for _, r in out], pa.float64())], names=["cell", "q", "qd", "least"])

    return run


def top_products(df: DataFrame, of: str = "vec_id % 50 = 0", top: int = 5, scale: int = 256, id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for each row that meets `of` (an expression of vec_id) the `top` other rows of the greatest inner
    product of floor(scale * x), ties to the smaller vec_id; all, if there are fewer.

    Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id or with a scaled component of 2**28 or more,
    for a score must fit a long. Vectors of unlike lengths are multiplied as far as both go; all are held as long as the longest is. A row that stands twice with
    one id and one vector counts once; with unlike vectors each is a row of its own. An empty table gives no rows; further columns are not read.

    The driver gets at most SAMPLE vectors to choose the pivots from, and the ranges of the cells, one for each pivot.
    """
    spark = df.sparkSession
    small_batches(spark)
    rows = stage(_vectors(df, scale, id, vector), "vectors")
    dims = max(1, (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 4)
    # a query's own row may be among the ids of its vector, so one more is kept
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= top + 1)
    candidates = stage(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "candidates")
    sample = candidates.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE)
    chosen = choose_pivots(_packed(pa.array([r["v"] for r in sample.collect()], pa.binary()), dims), pivots)
    count = len(chosen)
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = candidates.mapInArrow(_placed(chosen, dims), "v binary, ids array<long>, cell int, own double, d binary")
    blocks = stage(placed.repartitionByRange("cell", "own", "v").sortWithinPartitions("cell", "own", "v").mapInArrow(_blocks(dims, count), _BLOCKS), "blocks")
    spans = blocks.select("cell", "norm", F.posexplode(F.arrays_zip("lo", "hi")).alias("p", "z")).groupBy("cell", "p").agg(F.min("z.lo").alias("lo"), F.max("z.hi").alias("hi"), F.max("norm").alias("norm"))
    reach: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    for r in spans.collect():  # pivots * pivots rows at most
        lo, hi, _ = reach.setdefault(r["cell"], (np.zeros(count), np.zeros(count), r["norm"]))
        lo[r["p"]], hi[r["p"]] = r["lo"], r["hi"]

    asked = stage(rows.where(of).select("v").distinct().mapInArrow(_placed(chosen, dims), "v binary, cell int, own double, d binary"), "queries")

    def meet(queries: DataFrame, known) -> DataFrame:
        chunks = queries.repartitionByRange("cell", "own", "v").sortWithinPartitions("cell", "own", "v").mapInArrow(_chunks(dims, count, known), _CHUNKS)
        both = chunks.join(blocks.select("cell", "v", "d", "ids", "ends"), "cell")
        return both.mapInArrow(_pairs(dims, count, top + 1), "v binary, vec_id long, score long")

    best = Window.partitionBy("v").orderBy(F.col("score").desc(), "vec_id")
    first = stage(meet(asked.withColumn("least", F.lit(float("-inf"))), None).withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1), "own")
    least = first.where(F.col("r") == top + 1).select("v", F.col("score").cast("double").alias("least"))
    later = asked.join(least, "v", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    every = first.drop("r").unionByName(meet(later, reach))
    found = every.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("z"))
    queries = rows.where(of).select(F.col("vec_id").alias("query_id"), "v", "n")
    answers = queries.join(stage(found, "found"), "v")
    own = F.array_position("z", F.struct((-F.col("n")).alias("s"), F.col("query_id").alias("vec_id"))).cast("int")  # the query's own row, or 0
    rest = F.when(F.col("own") > 0, F.concat(F.expr("slice(z, 1, own - 1)"), F.expr("slice(z, own + 1, size(z))"))).otherwise(F.col("z"))
    others = answers.withColumn("own", own).withColumn("z", rest).select("query_id", F.posexplode(F.slice("z", 1, top)).alias("p", "y"))
    unstage(first, blocks, candidates, asked)
    return others.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("y.vec_id").alias("vec_id"), (-F.col("y.s")).alias("score"))


def sql(top: int = 5, scale: int = 256, step: int = 50) -> str:
    """The same in DuckDB: every stated query against all rows."""
    return f"""
WITH x AS MATERIALIZED (SELECT DISTINCT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score FROM x q JOIN x c ON (c.vec_id <> q.vec_id OR c.v <> q.v) WHERE q.vec_id % {step} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {top}
"""
