"""Document fingerprints: MinHash over word shingles, and the near-duplicate pairs that signature bands find.

A fingerprint is the MinHash signature of a text's shingles, 128 values of 16 bits in hexadecimal. Shingles are
runs of five words of the text with four blank words put before it, so a text of n words has n of them and a
short text keeps most of its shingles when its end is edited. The likeness of two fingerprints is the share of
equal values, an unbiased estimate of the Jaccard similarity of the shingle sets (standard error 0.044 at most).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_runs, map_arrow, mix, small_batches, stage
from .minhash import Permutations
from .neardup import Join

POSITIONS, WORDS, BANDS, LEAD = 128, 5, 32, np.arange(1, 5, dtype=np.uint64)


def padded_shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    return np.unique(hash_runs(np.concatenate([LEAD[: k - 1], words]), k)) if len(words) else words


def signatures(column: pa.Array, permutations: Permutations, k: int = WORDS) -> np.ndarray:
    """Texts x positions."""
    words = Words(column)
    out = np.empty((len(words), permutations.n), np.uint16)
    for j in range(len(words)):
        out[j] = permutations.least(padded_shingles(words.of(j), k))
    return out


def spelled(rows: np.ndarray) -> list[str]:
    raw, width = rows.astype(">u2").tobytes(), rows.shape[1] * 2
    return [raw[j : j + width].hex() for j in range(0, len(raw), width)]


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return (one == two).mean(axis=1)


def fingerprint(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id and fingerprint. Null and empty texts share the fingerprint of no shingles."""
    permutations = Permutations(POSITIONS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelled(signatures(batch.column(1), permutations)), pa.string())], names=["doc_id", "fingerprint"])

    return map_arrow(df.select(F.col(id).alias("i"), F.col(text).alias("x")), run, "doc_id long, fingerprint string")


def with_next(df: DataFrame, id: str = "doc_id", text: str = "text", blocks: int | None = None, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Rows are ordered by descending id, then text; the next of the last is the first, of a lone row itself. Null
    ids come last, null texts count as empty. The edited text is the text with its last floor(n_chars/3) code
    points replaced by the first as many of the next text, or by all of it.

    The table is cut into blocks of ids at sampled quantiles and each text is shuffled once, to its block. What a
    block needs from the next one is that block's first row alone: these rows, one per block, are sent twice.

    classes: (i, t, c), a class for ids and xxhash64 of texts, which becomes the column class_id; they travel in the same shuffle.
    """
    spark = df.sparkSession
    if blocks is None:
        blocks = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = df.select(F.coalesce(F.col(id), F.lit(-(2**63))).alias("i"), F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("x"), F.xxhash64(F.col(text)).alias("t"))
    cuts = docs.select(F.percentile_approx("i", [j / blocks for j in range(1, blocks)] or [0.5], 100 * blocks)).first()[0] or []
    cuts = sorted(set(cuts))
    edges = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def block_of(ids: pa.Array) -> pa.Array:  # block b holds the ids in (cuts[b - 1], cuts[b]]; an id is in one block whole
        return pa.array(np.searchsorted(edges, np.asarray(ids)).astype(np.int32))

    docs = docs.withColumn("b", block_of(F.col("i")))
    heads = {r.b: r.i for r in docs.groupBy("b").agg(F.max("i").alias("i")).collect()}  # as many rows as blocks
    order = sorted(heads, reverse=True)
    lead = np.full(len(edges) + 1, -1, np.int32)  # the first row of order[j] follows the last row of order[j - 1]
    top = np.full(len(edges) + 1, -1, np.int64)
    for j, b in enumerate(order):
        lead[b], top[b] = order[j - 1], heads[b]

    @F.arrow_udf("int")
    def leads(blocks_: pa.Array, ids: pa.Array) -> pa.Array:
        at = np.asarray(blocks_)
        return pa.array(np.where(top[at] == np.asarray(ids), lead[at], -1).astype(np.int32))

    tops = docs.withColumn("lead", leads(F.col("b"), F.col("i"))).where("lead >= 0")
    # of rows that share a block's largest id, the first in order leads
    first = tops.groupBy(F.col("lead").alias("b")).agg(F.min("x").alias("x"))
    none = F.lit(None).cast("long")
    guests = first.select(none.alias("i"), none.alias("doc_id"), "x", none.alias("t"), none.alias("c"), "b", F.lit(1).alias("guest"))
    rows = docs.withColumns({"guest": F.lit(0), "c": none}).unionByName(guests)
    if classes is not None:
        rows = rows.unionByName(classes.select("i", none.alias("doc_id"), F.lit("").alias("x"), "t", "c", block_of(F.col("i")).alias("b"), F.lit(0).alias("guest")))
    # an id's classes come before its texts
    dealt = rows.repartitionByRange(max(1, len(order)), "b").sortWithinPartitions(F.col("b").desc(), "guest", F.col("i").desc(), F.col("c").isNull(), "x")
    permutations = Permutations(POSITIONS)

    def run(batches) -> Iterator[pa.RecordBatch]:
        rest = None  # the last row seen, which waits for its next; batches of one block follow each other
        known: dict[tuple[int, int], int] = {}
        for batch in batches:
            given = np.flatnonzero(batch.column(5).is_valid())
            ids, keys = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            known = {x: v for x, v in known.items() if ids and x[0] == ids[0]}
            known |= {(ids[j], keys[j]): batch.column(5)[j].as_py() for j in given.tolist()}
            own = pa.array([known.get(x) for x in zip(ids, keys, strict=True)], pa.int64())
            batch = pa.RecordBatch.from_arrays([*batch.columns[:3], own], names=["doc_id", "x", "guest", "class_id"]).filter(batch.column(5).is_null())
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table.num_rows > 1:
                yield pairs(table.combine_chunks())
            rest = table.slice(table.num_rows - 1)

    def pairs(table: pa.Table) -> pa.RecordBatch:
        texts = table.column("x").combine_chunks()
        real = np.flatnonzero(np.asarray(table.column("guest"))[:-1] == 0)
        plain, edited, counts, digests = texts.to_pylist(), [], [], []
        for j in real:
            n = len(plain[j])
            k = n // 3
            e = plain[j][: n - k] + plain[j + 1][:k]
            counts.append(n)
            edited.append(e)
            digests.append(hashlib.sha256(e.encode()).hexdigest())
        own = signatures(texts, permutations)
        changed = signatures(pa.array(edited, pa.string()), permutations)
        columns = [table.column("doc_id").combine_chunks().take(pa.array(real)), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(spelled(own[real]), pa.string()), pa.array(spelled(changed), pa.string())]
        columns += [pa.array(likeness(own[real], changed), pa.float64()), pa.array(likeness(own[real], own[real + 1]), pa.float64())]
        columns += [table.column("class_id").combine_chunks().take(pa.array(real))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"])

    small_batches(spark, 256)
    out = dealt.select("doc_id", "x", "guest", "i", "t", "c").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long")
    return out.drop("class_id") if classes is None else out


class Bands(Join):
    """The similarity join of neardup.py, with the bands of fingerprints in place of nodes: texts whose signatures agree in a band
    meet, and links between what has met are verified on the full sets of shingles."""

    positions, margin, lower, lead = POSITIONS, 0.13, False, WORDS - 1

    def nodes(self):
        bands, width = BANDS, POSITIONS // BANDS

        def run(signatures: np.ndarray) -> np.ndarray:
            parts = signatures.astype(np.uint64).reshape(-1, bands, width)
            keys = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[None, :], parts.shape[:2]))
            for j in range(width):
                keys = mix(keys ^ parts[:, :, j])
            return keys >> np.uint64(3) << np.uint64(3) | (np.arange(bands, dtype=np.uint64) % np.uint64(8))[None, :]

        return run


def similar(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, **options) -> DataFrame:
    """One row for each input row: doc_id, class_id, the least id that links between texts of that similarity reach.

    Fingerprints are cut into BANDS bands; at 0.8 a pair shares one with probability 0.9999999. Texts that share a band are
    compared across the classes found so far, and links are verified on the full sets, word by word, so none is wrong. Null and empty
    texts have no links; rows without an id have a null class. Empty tables give no rows.
    """
    return Bands(df, id, text, WORDS, percent, depth=0, **options).run().select(F.col("i").alias("doc_id"), F.col("c").alias("class_id"))


def with_classes(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 80, **options) -> DataFrame:
    """with_next() and the class_id that similar() gives each row."""
    found = Bands(df, id, text, WORDS, percent, depth=0, **options).run()
    return with_next(df, id, text, classes=stage(found.where("i is not null").select("i", "t", "c").distinct(), "similar"))
