"""Approximate matching of one pattern in many texts, bit-parallel, as browser search libraries score it.

Each letter of a text becomes a mask of the places where the pattern has it, whatever its case. One run over the masks
gives the least number of errors (letters put in, left out or changed) with which the pattern stands anywhere in the text, in Myers' form of Bitap,
for all rows at once; the same masks give the runs of letters to highlight. Texts are cut into pieces that overlap by
twice the pattern, which no match within its length in errors can exceed.
"""

from __future__ import annotations

import numpy as np

#: Letters of a pattern in one machine word; longer patterns are matched in parts. Letters of a piece of text.
WORD, PIECE = 32, 512
# The least score of a match that is no equal text, and what a score of 0 counts as in a product.
FLOOR, EPSILON = 0.001, 2.0**-52


def parts(pattern: str) -> list[str]:
    """The pattern in parts of WORD letters; the last one reaches back to be as long."""
    if len(pattern) <= WORD:
        return [pattern]
    out = [pattern[i : i + WORD] for i in range(0, len(pattern) - WORD + 1, WORD)]
    return out if len(pattern) % WORD == 0 else [*out, pattern[-WORD:]]


class Texts:
    """The letters of a list of texts; null counts as empty."""

    def __init__(self, texts: list[str | None]):
        self.texts = [t or "" for t in texts]
        self.codes = np.frombuffer("".join(self.texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([0, *map(len, self.texts)])

    def masks(self, part: str) -> np.ndarray:
        """For each letter the places of the part that have it, in either case."""
        places: dict[int, int] = {}
        for i, c in enumerate(part):
            for form in {c, c.lower(), c.upper()}:
                if len(form) == 1:
                    places[ord(form)] = places.get(ord(form), 0) | 1 << i
        table = np.zeros(max(places, default=0) + 2, np.uint64)
        for code, bits in places.items():
            table[code] = bits
        return table[np.minimum(self.codes, len(table) - 1)]

    def errors(self, masks: np.ndarray, m: int) -> np.ndarray:
        """The least number of errors of a part of m letters in each text; m where nothing fits."""
        sizes = np.diff(self.ends)
        cuts = np.maximum(1, -(-np.maximum(sizes - 2 * m, 0) // PIECE))
        row = np.repeat(np.arange(len(sizes)), cuts)
        at = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * PIECE
        length = np.minimum(sizes[row] - at, PIECE + 2 * m)
        order = np.argsort(-length, kind="stable")
        start, length = (self.ends[row] + at)[order], length[order]
        one, top = np.uint64(1), np.uint64(m - 1)
        plus, minus = np.full(len(row), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(row), np.uint64)
        now = np.full(len(row), m, np.int64)
        least = now.copy()
        for j in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -j, side="left"))  # pieces longer than j
            same, p, q = masks[start[:n] + j], plus[:n], minus[:n]
            across = (((same & p) + p) ^ p) | same
            up, down = q | ~(across | p), p & across
            now[:n] += ((up >> top) & one).astype(np.int64) - ((down >> top) & one).astype(np.int64)
            up, down = up << one, down << one
            plus[:n], minus[:n] = down | ~(same | q | up), up & (same | q)
            np.minimum(least[:n], now[:n], out=least[:n])
        out = np.full(len(sizes), m, np.int64)
        np.minimum.at(out, row[order], least)
        return out

    def runs(self, marked: np.ndarray, shortest: int, most: int) -> list[list[str]]:
        """The first runs of marked letters of each text that are long enough."""
        edge = np.zeros(len(marked) + 1, bool)
        edge[self.ends[:-1]] = True
        on = marked & (edge[:-1] | ~np.concatenate([[False], marked[:-1]]))
        begins = np.flatnonzero(on)
        off = marked & np.concatenate([~marked[1:] | edge[1:-1], [True]])[: len(marked)]
        stops = np.flatnonzero(off) + 1
        long = stops - begins >= shortest
        begins, stops = begins[long], stops[long]
        first = np.searchsorted(begins, self.ends)
        return [[self.texts[i][b - self.ends[i] : e - self.ends[i]] for b, e in zip(begins[lo : min(hi, lo + most)], stops[lo : min(hi, lo + most)], strict=True)] for i, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True))]

    def words(self) -> np.ndarray:
        """How many runs of letters other than blanks each text has."""
        solid = self.codes != 32
        edge = np.zeros(len(solid) + 1, bool)
        edge[self.ends[:-1]] = True
        starts = np.cumsum(np.concatenate([[0], solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))]))
        return starts[self.ends[1:]] - starts[self.ends[:-1]]


def matched(texts: list[str | None], pattern: str, threshold: float, shortest: int, most: int) -> tuple[np.ndarray, list[list[str]], np.ndarray]:
    """(scores, runs, words) of each text: a score from 0 (the text is the pattern) to `threshold`, NaN where it does not match. A text matches where some part of the
    pattern fits with few enough errors and some run of its letters is `shortest` letters long; blank texts never do."""
    own = Texts(texts)
    total, any_, marked = np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(own.codes), bool)
    each = parts(pattern)
    for part in each:
        masks = own.masks(part)
        errors = own.errors(masks, len(part))
        fits = errors / len(part) <= threshold
        total += np.where(fits, np.maximum(errors / len(part), FLOOR), 1.0)
        any_ |= fits
        marked |= masks != 0
    scores, runs = total / len(each), own.runs(marked, shortest, most)
    equal = np.array([t.lower() == pattern.lower() for t in own.texts], bool)
    good = (any_ & np.array([bool(r) for r in runs], bool) | equal) & np.array([bool(t.strip()) for t in own.texts], bool)
    runs = [[t][:most] if e else r for t, e, r in zip(own.texts, equal, runs, strict=True)]
    return np.where(good, np.where(equal, 0.0, scores), np.nan), runs, own.words()


def weighted(fields: list[list[str | None]], weights: list[float], pattern: str, threshold: float, shortest: int = 2, most: int = 3) -> tuple[np.ndarray, list[list[str]]]:
    """(scores, highlights) of rows: the product of the fields' scores, each to the power of its weight over the root of its number of words
    (to three digits); 0 is best, NaN is no match in any field."""
    n = len(fields[0]) if fields else 0
    product, hit, marks = np.ones(n), np.zeros(n, bool), [[] for _ in range(n)]
    for texts, weight in zip(fields, weights, strict=True):
        scores, runs, words = matched(texts, pattern, threshold, shortest, most)
        good = ~np.isnan(scores)
        norm = np.floor(1000 / np.sqrt(np.maximum(words, 1)) + 0.5) / 1000
        product = np.where(good, product * np.where(good, np.where(scores == 0, EPSILON, scores), 1.0) ** (weight * norm), product)
        hit |= good
        for i in np.flatnonzero(good).tolist():
            marks[i] += runs[i]
    return np.where(hit, product, np.nan), [m[:most] for m in marks]
