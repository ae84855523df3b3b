"""Extractive summaries by maximal marginal relevance, chunking and packing.

The encoder is a parameter: a function of a list of texts to a matrix of vectors. By default words are counted by hash
(lexspark/encoders.py). Encoding and the greedy selection, which looks back at what it has chosen, run in numpy on Arrow
batches, in one pass from sentences to summaries; everything else stays within the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.encoders import DEFAULT, Encoder
from lexspark.encoders import encoder as encoder_of
from lexspark.functions import text as T
from lexspark.functions import vectors as V
from lexspark.staging import arrow

# Name, number of sentences and lambda of the summaries that a document gets; the third is of the scope text.
GRID = (("short", 3, 0.75), ("detailed", 8, 0.65), ("sto_zakon_ureduje", 2, 0.80), ("na_koga_se_odnosi", 2, 0.45), ("sto_uvodi_ili_mijenja", 2, 0.60))


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def chosen(vectors: np.ndarray, query: np.ndarray, k: int, weight: float, digits: int | None = None, seen: dict | None = None) -> list[int]:
    """Places of the k vectors of greatest marginal relevance, in order of place; ties go to the first.

    digits: similarities and scores are rounded so, to be the same wherever they are summed. seen: what calls with the same vectors, query and digits share."""
    if not len(vectors):
        return []
    around = (lambda x: np.round(x, digits)) if digits is not None else (lambda x: x)
    seen = {} if seen is None else seen
    if not seen:
        length = np.linalg.norm(vectors, axis=1)
        seen["unit"] = vectors / np.where(length > 0, length, 1)[:, None]
        own = np.linalg.norm(query)
        seen["relevance"] = around(seen["unit"] @ (query / own if own > 0 else query))
    unit, relevance = seen["unit"], seen["relevance"]
    out, most = [int(relevance.argmax())], np.full(len(vectors), -np.inf)
    while len(out) < min(k, len(vectors)):
        if out[-1] not in seen:
            seen[out[-1]] = around(unit @ unit[out[-1]])
        most = np.maximum(most, seen[out[-1]])
        score = around(weight * relevance - (1 - weight) * most)
        score[out] = -np.inf
        out.append(int(score.argmax()))
    return sorted(out)


def mmr(vectors: Column, query: Column, k: int, weight: float, digits: int | None = None) -> Column:
    """Places (from 0) as array<int>; vectors is an array of vectors."""

    @arrow("array<int>")
    def run(many: pa.Array, one: pa.Array) -> pa.Array:
        out = []
        for vs, q in zip(many, one, strict=True):
            rows = vs.values
            if not vs.is_valid or not len(rows):
                out.append([])
                continue
            flat = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)
            out.append(chosen(flat, np.asarray(q.values, np.float64), k, weight, digits))
        return pa.array(out, pa.list_(pa.int32()))

    return run(vectors, query)


def mmr_groups(df: DataFrame, group: str, id: str, vector: str, k: int, weight: float, digits: int = 6) -> DataFrame:
    """(group, id, pick): k rows of each group by marginal relevance to the group's mean. Each pick is one maximum per
    group, combined before the shuffle, so groups may be of any size; ties go to the least id."""
    rows = df.join(V.mean(df, [group], vector, "__c"), group).withColumn("__r", F.round(V.cosine(F.col(vector), F.col("__c")), digits)).drop("__c")
    rows = rows.withColumn("__m", F.lit(None).cast("double"))
    picks = None
    for n in range(k):
        score = F.round(F.col("__r") if n == 0 else weight * F.col("__r") - (1 - weight) * F.col("__m"), digits)
        best = rows.withColumn("__s", score).groupBy(group).agg(F.min(F.struct((-F.col("__s")).alias("s"), id, vector)).alias("z")).select(group, F.col(f"z.{id}").alias("__id"), F.col(f"z.{vector}").alias("__v"))
        own = best.select(group, F.col("__id").alias(id), F.lit(n).alias("pick"))
        picks = own if picks is None else picks.unionByName(own)
        rows = rows.join(best, group).where(F.col(id) != F.col("__id")).withColumn("__m", F.greatest("__m", F.round(V.cosine(F.col(vector), F.col("__v")), digits))).drop("__id", "__v")
    return picks


def summary(df: DataFrame, text: str, k: int = 3, weight: float = 0.7, out: str = "summary", encoder: Encoder = encoder_of(DEFAULT)) -> DataFrame:
    """df with a column of the k sentences that say most, in order; a text of no more than k sentences stays as it is."""
    return summaries(df, text, ((out, k, weight),), 1 << 31, encoder)


def ranked(df: DataFrame, text: str, k: int = 3, weight: float = 0.7, out: str = "summary", encoder: Encoder = encoder_of(DEFAULT)) -> DataFrame:
    """df with the summary of k sentences, however short the text, and all sentences as `ranked` (idx, sentence, score) by
    their cosine with the whole text, the greatest first and equal ones in order. A text without sentences has an empty summary."""

    @arrow("struct<summary string, ranked array<struct<idx int, sentence string, score double>>>")
    def run(texts: pa.Array, many: pa.Array) -> pa.Array:
        rows = []
        for whole, items in zip(texts.to_pylist(), many.to_pylist(), strict=True):
            vectors = encoder([whole or "", *items])
            query, vectors = vectors[0], vectors[1:]
            lengths = np.linalg.norm(vectors, axis=1) * np.linalg.norm(query)
            scores = (vectors @ query) / np.where(lengths > 0, lengths, 1)
            order = np.argsort(-scores, kind="stable").tolist()
            best = " ".join(items[p] for p in chosen(vectors, query, k, weight))
            rows.append({"summary": best, "ranked": [{"idx": p, "sentence": items[p], "score": float(scores[p])} for p in order]})
        return pa.array(rows, pa.struct([("summary", pa.string()), ("ranked", pa.list_(pa.struct([("idx", pa.int32()), ("sentence", pa.string()), ("score", pa.float64())])))]))

    done = run(F.col(text), T.sentences(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("__r", done).withColumn(out, F.col("__r.summary")).withColumn("ranked", F.col("__r.ranked")).drop("__r")


def relevant(df: DataFrame, text: str, k: int = 3, weight: float = 0.75) -> DataFrame:
    """summary() with more weight on relevance than on difference."""
    return summary(df, text, k, weight)


def summaries(df: DataFrame, text: str, grid: tuple = GRID, limit: int = 100, encoder: Encoder = encoder_of(DEFAULT)) -> DataFrame:
    """df with one column for each row of the grid. Sentences are encoded once for all of them. A text of more than
    `limit` sentences is summed up in overlapping chunks first, three sentences each that say most of the chunk, and then
    once more: what these say together is what the sentences are then held against."""

    @arrow("array<string>")
    def run(texts: pa.Array, many: pa.Array) -> pa.Array:
        return pa.array([_summed(t or "", s or [], grid, limit, encoder) for t, s in zip(texts.to_pylist(), many.to_pylist(), strict=True)], pa.list_(pa.string()))

    df = df.withColumn("__s", T.sentences(F.coalesce(F.col(text), F.lit("")))).withColumn("__p", run(F.col(text), F.col("__s")))
    for j, (name, k, _) in enumerate(grid):
        df = df.withColumn(name, F.when(F.size("__s") <= k, F.col(text)).otherwise(F.get("__p", F.lit(j))))
    return df.drop("__s", "__p")


def _summed(text: str, items: list[str], grid: tuple, limit: int, encoder: Encoder) -> list[str | None]:
    """A summary for each row of the grid; None where the text stays as it is."""
    n = len(items)
    if all(n <= k for _, k, _ in grid):
        return [None] * len(grid)
    joined = lambda places: " ".join(items[p] for p in places)
    vectors = encoder([text, *items])
    whole, vectors = vectors[0], vectors[1:]
    parts = [np.arange(a, min(a + limit, n)) for a in range(0, n, max(1, limit - 5))] if n > limit else []
    of_parts = encoder([joined(p) for p in parts]) if parts else None
    out: list[str | None] = []
    seen: dict = {}
    for _, k, weight in grid:
        places, query = np.arange(n), whole
        if parts and n > k:
            places = np.concatenate([p[chosen(vectors[p], q, 3, weight)] for p, q in zip(parts, of_parts, strict=True)])
            query = encoder([joined(places)])[0]
        if n <= k:
            out.append(None)
        elif len(places) <= k:
            out.append(joined(places))
        else:
            out.append(joined(places[chosen(vectors[places], query, k, weight)] if parts else chosen(vectors, query, k, weight, seen=seen)))
    return out


def overlapping(items: Column, size: int = 100, overlap: int = 5) -> Column:
    """Chunks of `size` items that share `overlap`; the last may lie within the one before."""
    step = max(1, size - overlap)
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.slice(items, s + 1, F.lit(size)))


def packed(items: Column, most: int, length: Callable[[Column], Column] = F.length) -> Column:
    """Items joined by blanks into chunks of at most `most` in length; an item longer than that is a chunk by itself."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, x: Column) -> Column:
        n = length(x).cast("bigint")
        full = (s["n"] + n > most) & (F.size(s["now"]) > 0)
        return F.when(full, F.struct(F.concat(s["done"], F.array(F.array_join(s["now"], " "))).alias("done"), F.array(x).alias("now"), n.alias("n"))).otherwise(
            F.struct(s["done"].alias("done"), F.concat(s["now"], F.array(x)).alias("now"), (s["n"] + n).alias("n"))
        )

    return F.aggregate(items, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(F.array_join(s["now"], " ")))).otherwise(s["done"]))
