"""Evaluation: precision and recall of selections, and how far similarities tell pairs apart."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.staging import arrow


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def precision_recall(df: DataFrame, keys: list[str], predicted: Column, actual: Column, digits: int = 6) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of each group, or of all rows without keys; 0 where nothing is divided by."""
    count = lambda p, a: F.sum(F.when((predicted == p) & (actual == a), 1).otherwise(0))
    rows = (df.groupBy(*keys) if keys else df.groupBy()).agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = rows.withColumn("p", p).withColumn("r", r)
    return rows.select(*keys, "tp", "fp", "fn", "tn", F.round("p", digits).alias("precision"), F.round("r", digits).alias("recall"), F.round(_share(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), digits).alias("f1"))


def separation(df: DataFrame, similarity: Column, label: Column, digits: int = 6) -> DataFrame:
    """Mean similarity of all, similar (label 1) and other pairs, and the difference of the latter two."""
    rows = df.agg(F.avg(similarity).alias("m"), F.avg(F.when(label == 1, similarity)).alias("a"), F.avg(F.when(label == 0, similarity)).alias("b"))
    return rows.select(F.round("m", digits).alias("mean_all"), F.round("a", digits).alias("mean_similar"), F.round("b", digits).alias("mean_dissimilar"), F.round(F.col("a") - F.col("b"), digits).alias("separation"))


def pair_similarity(a: Column, b: Column, encoder: Callable[[list[str]], np.ndarray]) -> Column:
    """The cosine of the vectors of two texts, each encoded by itself, so no filling up of batches and no mask takes part; 0 if one has no length."""

    @arrow("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            u, v = encoder([x or ""])[0], encoder([y or ""])[0]
            length = float(np.linalg.norm(u) * np.linalg.norm(v))
            out.append(float(u @ v) / length if length else 0.0)
        return pa.array(out, pa.float64())

    return run(a, b)
