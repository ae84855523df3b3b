"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of n letters may differ from a passage by `budget(n)` edits. It is cut into one piece more than
that, so in any passage within the budget one piece at least stands unchanged. All pieces of all items form one
Aho-Corasick automaton that each document runs through once; around the pieces that are met, Myers' bit-parallel
distance (semi-global: the item against any stretch of the window) decides. Windows of an item that overlap are one
stretch, which is run through once, so a text costs its length for each item at most, however often pieces repeat.

The budget is a share of the item's letters, but a piece has `piece` letters at least: an item of n letters may differ by
n // piece - 1 edits where that is less, with a share of 6 % and pieces of 16 letters below some 400 letters. Shorter pieces are
met more often and cost more; with `piece` no greater than 1 / (share + 1 / n) every item of n letters has its whole share.
An item of fewer than WHOLE letters is no evidence inside a longer word, so it must stand as words of its own: not
between letters with case or digits (scripts that do not part words have no case).

Letters are code points after folding: runs of white space become one blank, A-Z become a-z.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Benchmark text of more bytes than this is not broadcast in one part but matched in several, each within the bound.
PART_BYTES = 8 << 20
#: A worker keeps the automata of parts of so many bytes in all.
KEPT_BYTES = 4 * PART_BYTES
#: Shortest piece by default; items too short for budget + 1 such pieces get a smaller budget.
PIECE = 16
#: Items of fewer letters are found as whole words only.
WHOLE = 16
_BLANK = re.compile(r"[\x20\x09-\x0d]+")
_ASCII = str.maketrans({c: c + 32 for c in range(65, 91)})


def fold(text: str) -> str:
    """Runs of white space as one blank, none at the ends; A-Z as a-z."""
    return _BLANK.sub(" ", text).strip(" ").translate(_ASCII)


def budget(length: int, share: float, piece: int = PIECE) -> int:
    return max(0, min(int(length * share), length // piece - 1))


def pieces(text: str, share: float, piece: int = PIECE) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their offsets."""
    n = budget(len(text), share, piece) + 1
    cuts = [len(text) * j // n for j in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _in_word(text: str, at: int) -> bool:
    """Whether the place stands between two letters of one word."""
    return 0 < at < len(text) and all(c.isdigit() or c.lower() != c.upper() for c in text[at - 1 : at + 1])


class Pattern:
    """Myers' bit vectors of a pattern, in Python integers of any width."""

    def __init__(self, text: str):
        self.m = len(text)
        self.masks: dict[str, int] = {}
        for j, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << j

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """The least distance of the pattern to any stretch of text and the leftmost end of such, if at most `most`."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        plus, minus, score, found = full, 0, self.m, None
        get = self.masks.get
        for at, c in enumerate(text):
            eq = get(c, 0)
            x = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | (full & ~(x | plus))
            down = plus & x
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full  # the first row is free: no carry into it
            y = eq | minus
            plus = down | (full & ~(y | up))
            minus = up & y
            if score <= most:
                found, most = (score, at + 1), score - 1
                if most < 0:
                    break
        return found


class Matcher:
    def __init__(self, items: list[tuple[int, str]], share: float, piece: int = PIECE):
        self.items = [(i, fold(t or "")) for i, t in items]
        self.most = [budget(len(t), share, piece) for _, t in self.items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            if text:
                for at, part in pieces(text, share, piece):
                    where.setdefault(part, []).append((k, at))
        for part, hits in where.items():
            self.automaton.add_word(part, (len(part), hits))
        self.some = bool(where)
        if self.some:
            self.automaton.make_automaton()
        self.pattern = lru_cache(4096)(lambda k: Pattern(self.items[k][1]))
        self.backward = lru_cache(4096)(lambda k: Pattern(self.items[k][1][::-1]))

    def match(self, folded: str) -> list[tuple[int, int, int, int]]:
        """(item's index, distance, start, end) of the best passage of each item in each stretch of the text that holds it."""
        if not self.some:
            return []
        stretches: dict[int, list[list[int]]] = {}
        for end, (length, hits) in self.automaton.iter(folded):
            for k, offset in hits:
                m, most = len(self.items[k][1]), self.most[k]
                lo = end + 1 - length - offset - most
                hi = lo + m + 2 * most
                if m < WHOLE and not most and (_in_word(folded, lo) or _in_word(folded, hi)):
                    continue
                own = stretches.setdefault(k, [])
                # a piece's windows begin in order but for the offsets of an item's pieces
                while own and lo <= own[-1][1] and hi >= own[-1][0]:
                    lo, hi = min(lo, own[-1][0]), max(hi, own[-1][1])
                    own.pop()
                own.append([lo, hi])
        out = []
        for k, own in stretches.items():
            m, most = len(self.items[k][1]), self.most[k]
            own.sort()
            merged = [own[0]]
            for lo, hi in own[1:]:
                if lo <= merged[-1][1]:
                    merged[-1][1] = max(hi, merged[-1][1])
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                lo = max(0, lo)
                hit = self.pattern(k).best(folded[lo:hi], most)
                if hit:
                    stop = lo + hit[1]
                    head = self.backward(k).best(folded[max(0, stop - m - most) : stop][::-1], hit[0])
                    out.append((k, hit[0], stop - (head[1] if head else m), stop))
        return sorted(out)


def _parts(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in parts of bounded size, one after the other: the driver never holds more than one."""
    part, size = [], 0
    for r in benchmark.select(F.col(item), F.col(text)).where(F.col(text).isNotNull()).orderBy(item, text).toLocalIterator():
        more = len(r[1].encode())
        if part and size + more > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((r[0], r[1]))
        size += more
    if part:
        yield part


_matchers: dict[str, tuple[int, Matcher]] = {}


def _named(part: list[tuple[int, str]], share: float, piece: int) -> str:
    return hashlib.sha256(repr((part, share, piece)).encode()).hexdigest()


def _matcher(name: str, sent: Broadcast, share: float, piece: int) -> Matcher:
    """The matcher of a part, kept by this worker; those used longest ago give way."""
    if name in _matchers:
        _matchers[name] = found = _matchers.pop(name)
        return found[1]
    items = sent.value
    size = sum(len(t) for _, t in items)
    while _matchers and sum(n for n, _ in _matchers.values()) + size > KEPT_BYTES:
        del _matchers[next(iter(_matchers))]
    _matchers[name] = size, Matcher(items, share, piece)
    return _matchers[name][1]


def leaks(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.06, piece: int = PIECE) -> DataFrame:
    """(doc_id, item_id, distance, allowed, start, end, passage) of the passages of each item in each document: the best one of
    each stretch in which passages of the item could overlap.

    share: the edits allowed, as a share of the item's letters; piece: the fewest letters of a piece. start and end are places
    in the folded text. Null and empty texts hold nothing and null or blank items are found nowhere; an item shorter than two
    pieces must stand unchanged, and one of fewer than WHOLE letters that allows no edits as whole words. Rows repeated in either table are each reported. Empty tables give no rows. The items
    reach executors in a broadcast of at most PART_BYTES bytes; a longer list is matched part by part.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id).alias("i"), F.col(text).alias("x")).where(F.length("x") > 0)
    schema = "doc_id long, item_id long, distance int, allowed int, start int, end int, passage string"
    out = None
    for part in chain(_parts(benchmark, item, item_text), [[]]):
        if out is not None and not part:  # an empty benchmark still needs a plan
            break
        name = _named(part, share, piece)
        sent = spark.sparkContext.broadcast(part)

        def run(batch: pa.RecordBatch, name=name, sent=sent) -> Iterator[pa.RecordBatch]:
            matcher, rows = _matcher(name, sent, share, piece), []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded = fold(x)
                for k, distance, start, end in matcher.match(folded):
                    rows.append((i, matcher.items[k][0], distance, matcher.most[k], start, end, folded[start:end]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "allowed", "start", "end", "passage"])

        found = map_arrow(docs, run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", share: float = 0.06, piece: int = PIECE) -> DataFrame:
    """df without the documents that hold a benchmark passage; all columns stay, whatever their names, and so do null and
    empty texts. Repeated rows go or stay together. An empty benchmark drops nothing, and empty tables give no rows."""
    spark = df.sparkSession
    from .common import small_batches

    small_batches(spark)
    for part in _parts(benchmark, item, item_text):
        df = df.where(_clean(spark.sparkContext.broadcast(part), _named(part, share, piece), share, piece)(F.col(text)))
    return df


def _clean(sent: Broadcast, name: str, share: float, piece: int):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        matcher = _matcher(name, sent, share, piece)
        return pa.array([not matcher.match(fold(x)) if x else True for x in texts.to_pylist()], pa.bool_())

    return clean
