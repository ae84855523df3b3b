"""Vectors as arrays of numbers: products, lengths, means, as higher-order functions."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.staging import arrow

_WORDS = re.compile(r"[^\W_]+")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """v over its length; a null vector of zeros stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors, 0 if one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def mean(df: DataFrame, keys: list[str], vector: str, out: str = "mean") -> DataFrame:
    """The mean vector of each group: one average per dimension, combined before the shuffle."""
    each = df.select(*keys, F.posexplode(vector).alias("__d", "__x"))
    means = each.groupBy(*keys, "__d").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "__m"))), lambda s: s["__m"]).alias(out))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of those of an array of vectors whose mask is not 0; zeros if none is. A shorter mask ends in zeros."""
    pairs = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), F.coalesce(m, F.lit(0)).cast("double").alias("m"))), lambda p: p["v"].isNotNull())
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double") * 0)
    total = F.aggregate(pairs, zero, lambda s, p: F.zip_with(s, p["v"], lambda a, b: a + b.cast("double") * p["m"]))
    count = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["m"])
    return F.transform(total, lambda x: x / F.greatest(count, F.lit(1e-9)))


def encoded(texts: list[str], size: int = 64) -> np.ndarray:
    """The default encoder: a matrix with one row for each text, counts of words by hash, of length one."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        bins = [zlib.crc32(w.encode()) % size for w in _WORDS.findall((text or "").lower())]
        row += np.bincount(np.array(bins, np.int64), minlength=size)
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1.0)


def hashed(texts: Column, size: int = 64) -> Column:
    """encoded() as a Column, of an array of texts to an array of vectors."""

    @arrow("array<array<double>>")
    def run(many: pa.Array) -> pa.Array:
        return pa.array([encoded(row or [], size).tolist() for row in many.to_pylist()], pa.list_(pa.list_(pa.float64())))

    return run(texts)
