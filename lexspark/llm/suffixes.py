"""Repeated passages by sparse suffix arrays.

A suffix of a document is kept where its leading words are the least among the window's choices (a minimiser, as
in substrings.py): any two equal passages of `window` words keep a suffix at the same place. Suffixes are sorted
by their words; neighbours in that order share the longest beginnings. Each is compared with its neighbours of other
documents, and the match is extended to the right and to the left, word by word.

A suffix carries as many words on each side as can matter: a passage's first kept suffix lies within half a
window of its start and its last one within a window of its end, and matches of the suffixes between them overlap,
so their union is the whole passage, however long. No row holds more than that, and texts are not moved in pairs.

Suffixes whose first half window occurs in one document only are dropped before sorting. A group of equal
beginnings can hold a third of all rows: groups of more than `limit` are sorted in parts, the parts being formed
by id, and where a part has no neighbour of another document on one side, the suffix of the group's least or
greatest id stands in. Neighbours then depend on the parts; what is found does not, by the windows below, and neither does the
partner that is reported, which is theirs wherever more than two suffixes begin alike.

The neighbours in that order need not be the documents that share most to the left, so they alone do not find every
repeat. Where more than two suffixes begin alike, each window of `window` words around one is therefore also looked up by
its hash (64 bits, on whole words): a window that stands in two documents is found in both, whatever sorts between them and however groups are
split. The aggregates of a window are combined before the shuffle, so a very common one is no large group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, hash_runs, lists, map_arrow, signed, stage
from .substrings import picks

LIMIT = 4096


def _context(words: np.ndarray, places: np.ndarray, left: int, right: int) -> list[bytes]:
    """32 bits of each word around the places, 0 where the text has ended: `left` words before, `right` from there on. One of them
    marks a word, so a match goes on past its true end with probability 2**-31."""
    short = np.zeros(left + len(words) + right, np.uint32)
    short[left : left + len(words)] = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    rows = short[places[:, None] + np.arange(left + right)[None, :]].astype(">u4")
    # the suffix first, then what precedes it: binary order is then the order of suffixes
    rows = np.concatenate([rows[:, left:], rows[:, :left]], axis=1)
    return [r.tobytes() for r in rows]


def suffixes(df: DataFrame, id: str, text: str, window: int) -> DataFrame:
    """(h, z, i, p, s, a, w, q): kept suffixes that begin alike in several documents; z: how many begin so; s: their
    words. Where they are more than two, w has the hashes of the windows that keep the suffix, which start at a, a + 1
    and so on; q has where each first starts in the text, null if all do so at their own place."""
    docs = df.where(F.col(id).isNotNull()).select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))
    half = (window + 1) // 2

    def choose(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, places, hashes = Words(batch.column(2)), [], []
        for k in range(len(words)):
            p, h = (np.zeros(0, np.int64), np.zeros(0, np.uint64)) if words.count(k) < window else picks(words.of(k), window)[1:]
            places.append(p.astype(np.int32))
            hashes.append(signed(h))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(places, pa.int32()), lists(hashes, pa.int64())], names=["i", "t", "p", "h"])

    base = stage(map_arrow(docs, choose, "i long, t long, p array<int>, h array<long>"), "suffixes")
    each = base.select("i", "t", F.explode(F.arrays_zip("p", "h")).alias("z")).select("i", "t", F.col("z.p").alias("p"), F.col("z.h").alias("h"))
    many = each.groupBy("h").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.count("*").alias("z")).where("lo < hi").select("h", "z")
    alive = each.join(many, "h").groupBy("i", "t").agg(F.array_sort(F.collect_set(F.struct("p", "h", "z"))).alias("e"))
    alive = stage(alive.select("i", "t", "e.p", "e.h", "e.z"), "alive")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, out, starts, hashes, firsts = Words(batch.column(1)), [], [], [], []
        for k in range(len(words)):
            places = np.asarray(batch.column(2)[k].values).astype(np.int64)
            out += _context(words.of(k), places, window - half + 1, window + 1)
            each, full = picks(words.of(k), window)[0], hash_runs(words.of(k), window)
            lo, hi = np.searchsorted(each, places, "left"), np.searchsorted(each, places, "right")
            hi[np.asarray(batch.column(4)[k].values) <= 2] = 0
            _, at, back = np.unique(full, return_index=True, return_inverse=True)
            first = None if len(at) == len(full) else at[back].astype(np.int32)
            starts.append(lo)
            hashes += [signed(full[x:y]) for x, y in zip(lo, hi, strict=True)]
            firsts += [None if first is None else first[x:y] for x, y in zip(lo, hi, strict=True)]
        sizes = np.array([len(x) for x in batch.column(2)])
        flat = [batch.column(j).flatten() for j in (3, 4, 2)]
        columns = [flat[0], flat[1], pa.array(np.repeat(np.asarray(batch.column(0)), sizes)), flat[2], pa.array(out, pa.binary())]
        columns += [pa.array(np.concatenate(starts).astype(np.int32)), lists(hashes, pa.int64()), pa.array(firsts, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["h", "z", "i", "p", "s", "a", "w", "q"])

    # a document repeated under one id is read once
    rows = docs.join(alive, ["i", "t"]).dropDuplicates(["i", "t"]).select("i", "x", "p", "h", "z")
    return map_arrow(rows, read, "h long, z long, i long, p int, s binary, a int, w array<long>, q array<int>")


def shared(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, start, end, other_id, other_start): runs of following windows that stand in other documents too, with
    the least other id and a place of the window there."""
    full = rows.where("z > 2").select("i", "a", "q", F.posexplode("w").alias("n", "w"))
    full = full.select("i", (F.col("a") + F.col("n")).alias("p"), "w", F.coalesce(F.get("q", F.col("n")), F.col("a") + F.col("n")).alias("q"))
    # equal windows of a text have one q, so it does not matter which of them these take
    ends = full.groupBy("w").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.min_by("q", "i").alias("p1"), F.max_by("q", "i").alias("p2")).where("lo < hi")
    # of the least id the partner is the greatest, of others the least
    other = lambda least, greatest: F.when(F.col("i") > F.col("lo"), F.col(least)).otherwise(F.col(greatest))
    found = full.select("i", "p", "w").join(ends, "w").select("i", "p", other("lo", "hi").alias("i2"), (other("p1", "p2") - F.col("p")).alias("d"))
    # windows that follow each other here and there are one match
    found = found.groupBy("i", "i2", "d").agg(F.array_sort(F.collect_set("p")).alias("p"))

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in batch.column(3)])
        row, p = np.repeat(np.arange(len(sizes)), sizes), np.asarray(batch.column(3).flatten()).astype(np.int64)
        first = np.concatenate([[True], (row[1:] != row[:-1]) | (p[1:] > p[:-1] + window)])
        last = np.concatenate([first[1:], [True]])
        i, i2, d = (np.asarray(batch.column(j)).astype(np.int64)[row[first]] for j in range(3))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (i, p[first], p[last] + window, i2, p[first] + d)], names=["doc_id", "start", "end", "other_id", "other_start"])

    return map_arrow(found, join, "doc_id long, start long, end long, other_id long, other_start long")


def matches(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, limit: int = LIMIT) -> DataFrame:
    """(doc_id, start, end, other_id, other_start, later): each suffix's matches of `window` words or more with its neighbours,
    and the matches of windows by their hashes. later: 1 for neighbours in groups whose windows are looked up as well."""
    left, right = window - (window + 1) // 2 + 1, window + 1
    rows = suffixes(df, id, text, window)
    part = F.when(F.col("z") > limit, 1 + F.pmod(F.xxhash64("i"), F.ceil(F.col("z") / F.lit(limit)))).otherwise(F.lit(0)).cast("int")
    rows = stage(rows.withColumn("b", part), "sorted")
    windows, rows = shared(rows, window), rows.drop("a", "w", "q")
    heads = rows.where("b > 0").groupBy("h").agg(F.min(F.struct("i", "p", "s")).alias("head"), F.max(F.struct("i", "p", "s")).alias("tail"))
    # only the large groups take part in this join, and before neighbours are added to their rows
    none = F.lit(None).cast(heads.schema["head"].dataType)
    rows = rows.where("b = 0").withColumns({"head": none, "tail": none}).unionByName(rows.where("b > 0").join(heads, "h"))
    for name, way in (("prev", F.asc), ("next", F.desc)):
        # the nearest suffix of another document on that side
        order = Window.partitionBy("h", "b").orderBy(*map(way, ("s", "i", "p")))
        beside = F.lag(F.struct("i", "p", "s")).over(order)
        rows = rows.withColumn("n", beside).withColumn("n", F.when(F.col("n.i") != F.col("i"), F.col("n")))
        rows = rows.withColumn(name, F.last("n", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("n")
    own = rows.withColumn("o", F.explode(F.array_compact(F.array(F.coalesce("prev", "head"), F.coalesce("next", "tail")))))
    own = own.where("o.i <> i").select("i", "p", "s", F.col("o.i").alias("i2"), F.col("o.p").alias("p2"), F.col("o.s").alias("s2"), (F.col("z") > 2).cast("int").alias("later"))

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        a, b = (np.frombuffer(b"".join(batch.column(j).to_pylist()), ">u4").reshape(n, left + right) for j in (2, 5))
        same = (a == b) & (a != 0)
        after = np.logical_and.accumulate(same[:, :right], axis=1).sum(axis=1)
        before = np.logical_and.accumulate(same[:, right:][:, ::-1], axis=1).sum(axis=1)
        keep = before + after >= window
        i, p, i2, p2 = (np.asarray(batch.column(j))[keep].astype(np.int64) for j in (0, 1, 3, 4))
        before, after = before[keep], after[keep]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (i, p - before, p + after, i2, p2 - before)] + [batch.column(6).filter(pa.array(keep))], names=["doc_id", "start", "end", "other_id", "other_start", "later"])

    return map_arrow(own, extend, "doc_id long, start long, end long, other_id long, other_start long, later int").unionByName(windows.withColumn("later", F.lit(0)))


def repeated_passages(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, limit: int = LIMIT) -> DataFrame:
    """One row for each passage of a document that stands in another document too: doc_id, start, n_words, other_id,
    other_start, match_start, match_words (places and lengths in words, from 0).

    Overlapping matches of a document are one passage, so a passage is as long as repetition goes on: its words are those
    of all windows that stand in another document. One of its matches is named as well: the match_words words from match_start on
    are, word by word, those of other_id, the least id that the passage was matched with, from other_start on. None of these
    depends on `limit`. Null and empty texts, and texts of fewer words than a window, have no passages; nor do rows without an id.
    Rows of one id are not compared with each other; equal rows repeated under one id count once. Extra columns do not matter,
    whatever their names. Empty tables give no rows.
    """
    line = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    found = matches(df, id, text, window, limit).distinct()
    found = found.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("start")).cast("int")).withColumn("run", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = found.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("later", "other_id", "other_start", F.col("start").alias("at"), F.col("end").alias("to"))).alias("o"))
    own = (F.col("o.at").alias("match_start"), (F.col("o.to") - F.col("o.at")).alias("match_words"))
    return runs.select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_words"), "o.other_id", "o.other_start", *own)
