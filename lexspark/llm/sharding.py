"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard depends on the key and the number of shards alone; no ring table exists. Going from n to n + 1
shards moves a key either nowhere or into the new shard, and moves one key in n + 1 on average.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

_STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, for all keys at once: every pass jumps those that have not passed the end."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = mix(np.ascontiguousarray(keys, np.int64).view(np.uint64))
    at = np.zeros(len(state), np.int64)
    ahead = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        at[live] = ahead[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        ahead[live] = ((at[live] + 1) * (float(1 << 31) / ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[ahead[live] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long column; a null key counts as 0."""

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        return pa.array(jump(np.asarray(keys.fill_null(0).cast(pa.int64())), shards), pa.int32())

    return place(key)


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """One row for each input row: the key, size (UTF-8 bytes + 1; a null text has 0 bytes), text_crc32, law, shard, slot, grown_shard.

    law is ``key``: the key and the number of shards decide. slot numbers the rows of a shard from 0 without
    gaps, in the order of (bucket, key, crc). A shard is a sixteenth of all rows or more, so its rows are never
    sorted in one task: each shard is cut into `parts` buckets by a hash of the key and the crc, buckets are numbered apart, and
    the counts of at most shards * parts buckets, bounded by those two parameters, shift them. Rows of one key and one
    text share a bucket, of three small columns a row.

    Null keys: shard of key 0. Empty tables give no rows. Repeated rows each get a slot of their own.
    """
    spark = df.sparkSession
    if parts is None:
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), shards + 1)})
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int"))
    from pyspark.sql import Window

    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__shift"))
    own = Window.partitionBy("shard", "__bucket").orderBy("doc_id", "text_crc32", "size")
    slots = rows.withColumn("__at", F.row_number().over(own)).join(F.broadcast(shifts), ["shard", "__bucket"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__at") - 1 + F.col("__shift")).cast("long").alias("slot"), "grown_shard")
