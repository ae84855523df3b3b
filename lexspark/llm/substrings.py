"""Substring deduplication by level-wise doubling.

Windows of ``window`` consecutive words that also start in a document with a smaller id are removed. Candidates are
found level by level, and only what is repeated at one length is extended to twice that length:

1. Half windows. They need not all be listed: each full window picks the half window of the least hash inside it (a choice
   that depends on its words alone, so equal windows pick alike), about one word in fourteen in all. A full window can
   only be repeated when its pick is.
2. Full windows. Those that share a pick follow each other; together they are the pick's span, of a window's words or up to half a window
   more. A span that stands in several documents settles all its windows with one row. Only where a repeated pick has several
   spans, the single windows of each different span are listed, in the document of the least id that holds it, and compared.
3. Runs of neighbouring repeated spans, then runs of such runs, twice as long each time on average, until no candidate survives. A run begins
   where a digest is less than the one before it, so equal stretches are cut alike and half as many candidates go on from level to
   level. These levels remove nothing that level two does not; they measure how long repetition goes on (`longest`), and run where that is asked for.

Spans and windows are compared by 128-bit digests of their words (BLAKE2), which stand for the words themselves; the 64-bit
hashes of half windows only choose candidates. Equal spans, windows or runs of one document are one row with all its places, so a document
that repeats a line a thousand times sends it once. A very common passage makes one row per document and pick; such rows
are counted before they are shuffled, and joins meet them with staged tables of one row a key, so that skew handling can split them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, hash_runs, lists, map_arrow, signed, stage, unstage, unused


def picks(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each full window the place of its pick, leftmost among equals; then the distinct places and their hashes."""
    half = (window + 1) // 2
    halves = hash_runs(words, half)
    each = sliding_window_view(halves, window - half + 1).argmin(axis=1) + np.arange(len(words) - window + 1)
    # the same place can be picked, left and picked again only if picks were not monotone; they are
    places = each[np.concatenate([[True], each[1:] != each[:-1]])]
    return each, places, halves[places]


def covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of the places."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:-1]) > 0


def digests(data: bytes, at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits, as two numbers, of the words from starts[j] up to ends[j] of a joined text."""
    spans = zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)
    return np.frombuffer(b"".join([hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in spans]), "<i8").reshape(-1, 2)


def alike(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, each in the order it had, and where in it each distinct key begins."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        own = key[order]
        new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def nested(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """A column of lists of lists from each row's values and where in them each inner list begins."""
    sizes = [np.diff(np.append(first, len(values))) for values, first in rows]
    ends = np.cumsum(np.concatenate([[0], *sizes]))
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([values for values, _ in rows]), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sizes)]), pa.int32()), inner)


def spans(df: DataFrame, id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(base, alive). base: each row's key (i, t), number of words n and digest d of its words. alive: the picks that several
    documents hold, one row for each different span of a document: i, t, the span's length l in words and digest a, b, the numbers j of its
    picks in the text and the words x that it starts at, the pick's hash h, and whether that has more spans than one (many).

    The key is (id, xxhash64 of the text): rows repeated under one id share a result, and two texts under one id
    stay apart. Rows of one id never count as repetitions of each other.
    """
    docs = df.select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))

    def level_one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, whole, found = Words(batch.column(2)), [], []
        for k in range(len(words)):
            data, at = words.joined(k)
            whole.append(hashlib.sha256(data).hexdigest())
            if words.count(k) < window:
                found.append((np.zeros(0, np.int64),) * 7)
                continue
            each, places, h = picks(words.of(k), window)
            x, y = np.searchsorted(each, places, "left"), np.searchsorted(each, places, "right") - 1 + window
            own = digests(data, at, x, y)
            order, first = alike(own[:, 0], own[:, 1])  # equal spans have equal picks
            one = order[first]
            found.append((signed(h)[one], (y - x)[one], own[one, 0], own[one, 1], order, x[order], first))
        columns = [lists([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
        columns += [nested([(f[c], f[6]) for f in found]) for c in (4, 5)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(words.first), pa.int64()), pa.array(whole), *columns], names=["i", "t", "n", "d", "h", "l", "a", "b", "j", "x"])

    base = stage(map_arrow(docs, level_one, "i long, t long, n long, d string, h array<long>, l array<int>, a array<long>, b array<long>, j array<array<int>>, x array<array<int>>"), "picks")
    half = base.where("i is not null").select("i", "t", F.explode(F.arrays_zip("h", "l", "a", "b", "j", "x")).alias("z")).select("i", "t", "z.*")
    twice = half.groupBy("h").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), (F.min("a") < F.max("a")).alias("many")).where("lo < hi")
    twice = stage(twice.select("h", "many"), "twice")
    alive = stage(half.join(twice, "h"), "alive")
    unstage(twice)
    return base.select("i", "t", "n", "d"), alive


def windows(df: DataFrame, wanted: DataFrame, id: str, text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(i, t, s, a, b): all starts and the digest of each different single window of the picks wanted, (i, t, j); and the staged table below it."""
    docs = df.select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))

    def level_two(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, found = Words(batch.column(2)), []
        for k in range(len(words)):
            each, places, _ = picks(words.of(k), window)
            at = np.flatnonzero(np.isin(each, places[np.asarray(batch.column(3)[k].values)]))
            own = digests(*words.joined(k), at, at + window)
            order, first = alike(own[:, 0], own[:, 1])
            found.append((own[order[first], 0], own[order[first], 1], at[order], first))
        columns = [nested([(f[2], f[3]) for f in found]), *[lists([f[c] for f in found], pa.int64()) for c in (0, 1)]]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["i", "t", "s", "a", "b"])

    wanted = wanted.groupBy("i", "t").agg(F.flatten(F.collect_set("j")).alias("js"))
    near = docs.join(wanted, ["i", "t"]).dropDuplicates(["i", "t"]).select("i", "t", "x", "js")
    full = stage(map_arrow(near, level_two, "i long, t long, s array<array<int>>, a array<long>, b array<long>"), "windows")
    return full.select("i", "t", F.explode(F.arrays_zip("s", "a", "b")).alias("z")).select("i", "t", "z.*"), full


def repeated(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, measure: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(base, cut, longest): base as in spans(); cut has the keys of documents with repeated windows, the numbers js of the picks
    whose windows all are repeated, and the starts s of other repeated windows. longest, if it is to be measured: keys and words of
    the longest stretch found at the last level that it reaches."""
    base, alive = spans(df, id, text, window)
    first = stage(alive.groupBy("h", "a", "b").agg(F.min("i").alias("lo"), F.max("i").alias("hi")), "first")
    found = alive.join(first, ["h", "a", "b"])
    found = stage(found.select("i", "t", "j", "x", "l", "a", "b", (F.col("i") > F.col("lo")).alias("later"), (F.col("lo") < F.col("hi")).alias("several"), "many").where("many or several"), "found")
    unstage(alive, first)
    single, held = windows(df, found.where("many and not later").select("i", "t", "j"), id, text, window)
    lo = stage(single.groupBy("a", "b").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi").select("a", "b", "lo"), "lo")
    none = F.lit(None).cast("array<int>")
    single = single.join(lo, ["a", "b"]).where("i > lo").select("i", "t", none.alias("j"), "s")
    cut = found.where("later").select("i", "t", "j", none.alias("s")).union(single).groupBy("i", "t").agg(F.flatten(F.collect_set("j")).alias("js"), F.flatten(F.collect_set("s")).alias("s"))
    cut = stage(cut, "cut")
    unstage(lo, held)
    longest = doubled(found.where("several")) if measure else None
    unstage(found)
    return base, cut, longest


def doubled(spans: DataFrame) -> DataFrame:
    """(i, t, longest) from the repeated spans (i, t, j, x, l, a, b, later): neighbours that are repeated at one level are joined to the
    next level's candidates; those that several documents hold survive, until none does."""
    level, lengths = stage(spans.select("i", "t", "j", "x", "l", "a", "b", "later"), "level"), []

    def extend(batch: pa.RecordBatch) -> pa.RecordBatch:
        # one entry for each span of a row, then one for each of its places
        entries = np.asarray(batch.column(4).value_lengths())
        places = np.asarray(batch.column(2).flatten().value_lengths())
        row = np.repeat(np.repeat(np.arange(len(entries)), entries), places)
        j, x = (np.asarray(batch.column(c).flatten().flatten()) for c in (2, 3))
        length, a, b = (np.repeat(np.asarray(batch.column(c).flatten()), places) for c in (4, 5, 6))
        y = x + length
        order = np.lexsort((j, row))
        row, j, x, y, a, b = (v[order] for v in (row, j, x, y, a, b))
        apart = np.concatenate([[True], (row[1:] != row[:-1]) | (j[1:] != j[:-1] + 1)])
        # what has no neighbour can't be extended
        alone = apart & np.concatenate([apart[1:], [True]])
        # the second of a stretch begins no run, so every stretch gets shorter
        head = np.flatnonzero((apart | np.concatenate([[False], (a[1:] < a[:-1]) & ~apart[:-1]])) & ~alone)
        end = np.concatenate([head[1:], [len(row)]])
        stops = np.flatnonzero(apart)
        at = np.searchsorted(stops, head, side="right")  # a run ends where its stretch does
        end = np.minimum(end, np.concatenate([stops, [len(row)]])[at])
        names = np.stack([a, b], axis=1)
        names = np.frombuffer(b"".join([hashlib.blake2b(names[p:q].tobytes(), digest_size=16).digest() for p, q in zip(head.tolist(), end.tolist(), strict=True)]), "<i8").reshape(-1, 2)
        # neighbours stay neighbours, stretches stay apart
        number = (np.arange(len(head)) + np.cumsum(apart[head])).astype(np.int32)
        of, x, length = row[head], x[head], y[end - 1] - x[head]
        order, first = alike(length, names[:, 0], names[:, 1], of)
        one, ends = order[first], pa.array(np.append(first, len(order)), pa.int32())
        keys = [batch.column(c).take(pa.array(of[one])) for c in (0, 1)]
        where = [pa.ListArray.from_arrays(ends, pa.array(v[order], pa.int32())) for v in (number, x)]
        return pa.RecordBatch.from_arrays([*keys, *where, pa.array(length[one], pa.int32()), pa.array(names[one, 0]), pa.array(names[one, 1])], names=["i", "t", "j", "x", "l", "a", "b"])

    while not level.isEmpty():
        lengths.append(stage(level.where("later").groupBy("i", "t").agg(F.max("l").cast("long").alias("longest")), "lengths"))
        each = level.drop("later").distinct().groupBy("i", "t").agg(*[F.collect_list(c).alias(c) for c in ("j", "x", "l", "a", "b")])
        runs = stage(map_arrow(each, extend, "i long, t long, j array<int>, x array<int>, l int, a long, b long"), "runs")
        lo = stage(runs.groupBy("a", "b").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).where("lo < hi").select("a", "b", "lo"), "lo")
        after = stage(runs.join(lo, ["a", "b"]).select("i", "t", "j", "x", "l", "a", "b", (F.col("i") > F.col("lo")).alias("later")), "level")
        unstage(level, runs, lo)
        level = after
    out = level.select("i", "t", F.lit(0).cast("long").alias("longest"))
    for one in lengths:
        out = out.union(one)
    return out.groupBy("i", "t").agg(F.max("longest").alias("longest"))


def _kept(words: Words, k: int, js: pa.Array, starts: pa.Array, window: int) -> tuple[int, bytes]:
    """How many words of text k go, and what stays, joined by one space."""
    each, places, _ = picks(words.of(k), window)
    whole = np.flatnonzero(np.isin(each, places[np.asarray(js).astype(np.int64)]))
    gone = covered(np.concatenate([whole, np.asarray(starts).astype(np.int64)]), window, words.count(k))
    data, at = words.joined(k)
    # runs of kept words are slices of the joined text
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return int(gone.sum()), b" ".join(data[at[a] : at[b] - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space), longest.

    longest: words of the longest run that doubling found in a document of a smaller id as well; 0 where nothing is removed, and a
    window's words at least where something is. Runs are cut by content, so the true stretch can be longer.

    Null and empty texts have no words and lose none; texts shorter than a window lose none. Rows without an id
    are neither first nor later than any document and lose nothing. Empty tables give no rows.
    """
    base, cut, longest = repeated(df, id, text, window, measure=True)
    docs = df.select(F.col(id).alias("i"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, gone, found = Words(batch.column(2)), [], []
        for k in range(len(words)):
            n, kept = _kept(words, k, batch.column(3)[k].values, batch.column(4)[k].values, window)
            gone.append(n)
            found.append(hashlib.sha256(kept).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(found)], names=["i", "t", "r", "e"])

    changed = map_arrow(docs.join(cut, ["i", "t"]).select("i", "t", "x", "js", "s"), digest, "i long, t long, r long, e string").dropDuplicates(["i", "t"])
    out = base.join(changed, ["i", "t"], "left").join(longest, ["i", "t"], "left")
    removed, least = F.coalesce("r", F.lit(0)).cast("long"), F.greatest(F.coalesce("longest", F.lit(0)), F.lit(window)).cast("long")
    return out.select(F.col("i").alias("doc_id"), F.col("n").alias("n_words"), removed.alias("n_removed"), F.coalesce("e", "d").alias("kept_sha256"), F.when(removed > 0, least).otherwise(F.lit(0).cast("long")).alias("longest"))


def strip_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", window: int = 50, length: str | None = None) -> DataFrame:
    """df with repeated windows cut out of the text column; all other columns stay. Untouched texts stay as they are.

    Of a changed text the kept words are joined by one space; `length` names a column that holds the number of
    characters, to be set anew. Documents of which no word is left are dropped.
    """
    i, t, js, s = unused(df, "__i", "__t", "__js", "__s")
    cut = repeated(df, id, text, window)[1]
    cut = cut.select(F.col("i").alias(i), F.col("t").alias(t), F.col("js").alias(js), F.col("s").alias(s))
    joined = df.join(cut, (F.col(id) == F.col(i)) & (F.xxhash64(F.col(text)) == F.col(t)), "left").drop(i, t)

    @F.arrow_udf("string")
    def rest(texts: pa.Array, whole: pa.Array, starts: pa.Array) -> pa.Array:
        words = Words(texts)
        return pa.array([_kept(words, k, whole[k].values, starts[k].values, window)[1].decode() if whole[k].is_valid else None for k in range(len(words))], pa.string())

    changed = joined.withColumn(text, F.when(F.col(js).isNull(), F.col(text)).otherwise(rest(F.col(text), F.col(js), F.col(s))))
    changed = changed.where(F.col(js).isNull() | (F.col(text) != ""))
    if length:
        changed = changed.withColumn(length, F.when(F.col(js).isNull(), F.col(length)).otherwise(F.char_length(text).cast("long")))
    return changed.drop(js, s)
