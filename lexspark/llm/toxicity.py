"""Toxicity: a lexicon trie intersected with Levenshtein automata, and scores of the context that terms stand in.

The lexicon is learned from labelled rows: words, and stems of at least four letters, that toxic documents hold
far oftener than others. Its trie and the automata that allow one edit (a letter more, less, other, or two
exchanged) are multiplied into one deterministic automaton over letters, which all words of a batch run through
together, a letter a step; nearly all words fall dead within three steps. Terms and stems shorter than five and
six letters must be met exactly.

Each hit is looked at in its window of words: is it quoted (inside marks of quotation on its line, or in a line
that is quoted as in mail), and how many more hits are near? Sums over the document go to a logistic model whose
weights are drawn towards a prior in which abuse counts and quotation does not, so that features the labels say
little about keep sensible weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow
from .quality import SAMPLE, held_out, labelled

#: Words on each side of a hit that count as its context.
CONTEXT = 8
FEATURES = ("some", "exact", "near", "quoted", "close", "rate", "weight")
PRIOR = np.array([1.5, 1.5, 0.2, 0.0, 0.5, 0.2, 0.3])
_ALL = 0x110000
#: Letters and digits, by the categories of all of Unicode: one cut of words for learning and for scoring.
_ALNUM = np.frombuffer(bytes(map(str.isalnum, map(chr, range(_ALL)))), bool)
_FOLD = np.arange(_ALL, dtype=np.uint32)
for _c in range(_ALL):
    if _ALNUM[_c] and len(_low := chr(_c).lower()) == 1:
        _FOLD[_c] = ord(_low)
_QUOTES = np.zeros(_ALL, bool)
_QUOTES[[ord(c) for c in '"“”„«»‹›「」『』＂']] = True


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of all texts of a column; null counts as empty."""
    texts = column.fill_null("").to_pylist()
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def words_in(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters and digits, and each text's first run."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _ALNUM[points]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before = np.concatenate([[False], solid[:-1]])
    before[edge] = False
    after = np.concatenate([solid[1:], [False]])
    after[edge - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_words(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(y, w): the different words of each text, folded as the automaton folds them."""
    points, offsets = characters(batch.column(1))
    starts, ends, first = words_in(points, offsets)
    folded = _FOLD[points].tobytes().decode("utf-32-le", "surrogatepass")
    words = [sorted({folded[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)}) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    labels = np.repeat(np.asarray(batch.column(0)), [len(w) for w in words])
    return pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array([w for own in words for w in own], pa.string())], names=["y", "w"])


@dataclass
class Automaton:
    letters: np.ndarray  # the code points of the entries' letters in order: the first is of class 1; 0: a letter of no entry
    moves: np.ndarray  # states x classes; state 0 is dead
    hit: np.ndarray  # 0: none, 1: exact, 2: one edit; of words that end in a state
    entry: np.ndarray  # the entry that is met

    def run(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the kind of hit and the entry."""
        state = np.ones(len(starts), np.int32)
        if not len(starts):
            return self.hit[state], self.entry[state]
        live, step = np.arange(len(starts)), 0
        while len(live):
            c = _FOLD[points[starts[live] + step]]
            at = np.searchsorted(self.letters, c)
            c = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == c, at + 1, 0) if len(self.letters) else 0
            state[live] = moved = self.moves[state[live], c]
            step += 1
            live = live[(moved > 0) & (starts[live] + step < ends[live])]
        return self.hit[state], self.entry[state]


def build(entries: list[str]) -> Automaton:
    """The product of the entries' trie with Levenshtein automata. An entry that ends in ``*`` is a stem."""
    alphabet = {c: k + 1 for k, c in enumerate(sorted({c for e in entries for c in e.removesuffix("*")}))}
    letters = np.array(sorted(map(ord, alphabet)), np.uint32)
    # trie nodes: children, and the entry that ends there; edits allowed depend on the entry, so there are two tries
    tries: list[list[dict]] = []
    for edits in (0, 1):
        nodes: list[dict] = [{}]
        for at, e in enumerate(entries):
            stem, body = e.endswith("*"), e.removesuffix("*")
            if edits and len(body) < (6 if stem else 5):
                continue
            node = 0
            for c in body:
                nxt = nodes[node].get(alphabet[c])
                if nxt is None:
                    nodes.append({})
                    nxt = nodes[node][alphabet[c]] = len(nodes) - 1
                node = nxt
            nodes[node].setdefault("stem" if stem else "end", at)
        tries.append(nodes)
    # a configuration: (trie, node, edits used, letter owed to an exchange or 0); -1 as node: inside a met stem
    def close(items: frozenset) -> frozenset:
        out, todo = set(), list(items)
        while todo:
            x = todo.pop()
            if x in out:
                continue
            out.add(x)
            trie, node, used, owed = x
            if node >= 0 and not owed:
                if "stem" in tries[trie][node]:
                    todo.append((trie, -1 - tries[trie][node]["stem"], used, 0))
                if trie and not used:
                    todo += [(trie, child, 1, 0) for c, child in tries[trie][node].items() if isinstance(c, int)]
        return frozenset(out)

    def move(items: frozenset, letter: int) -> frozenset:
        out = set()
        for trie, node, used, owed in items:
            if node < 0:
                out.add((trie, node, used, 0))
                continue
            here = tries[trie][node]
            if owed:
                if letter == owed:
                    out.add((trie, node, used, 0))
                continue
            if letter in here:
                out.add((trie, here[letter], used, 0))
            if trie and not used:
                out.add((trie, node, 1, 0))
                for c, child in here.items():
                    if isinstance(c, int):
                        out.add((trie, child, 1, 0))
                        if letter in tries[trie][child] and letter != c:
                            out.add((trie, tries[trie][child][letter], 1, c))
        return close(frozenset(out))

    start = close(frozenset({(0, 0, 0, 0), (1, 0, 0, 0)}))
    number, todo, moves = {frozenset(): 0, start: 1}, [start], [[0] * (len(alphabet) + 1)]
    hits, met = [0], [-1]
    while todo:
        items = todo.pop(0)
        row, best = [], (3, -1)
        for trie, node, used, owed in items:
            if node < 0:
                best = min(best, (1 + used, -1 - node))
            elif not owed and "end" in tries[trie][node]:
                best = min(best, (1 + used, tries[trie][node]["end"]))
        hits.append(best[0] if best[0] < 3 else 0)
        met.append(best[1])
        for letter in range(len(alphabet) + 1):
            nxt = move(items, letter)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        moves.append(row)
    return Automaton(letters, np.array(moves, np.int32), np.array(hits, np.int8), np.array(met, np.int32))


@dataclass
class Model:
    entries: list[str]
    weights: np.ndarray  # of entries
    automaton: Automaton
    beta: np.ndarray  # of FEATURES, the last is the base

    def features(self, column: pa.Array) -> np.ndarray:
        points, offsets = characters(column)
        starts, ends, first = words_in(points, offsets)
        kind, entry = self.automaton.run(points, starts, ends)
        out = np.zeros((len(first) - 1, len(FEATURES)))
        at = np.flatnonzero(kind)
        if not len(at):
            return out
        text = np.searchsorted(first, at, side="right") - 1
        quoted = self._quoted(points, offsets, starts[at], ends[at], text)
        exact = (kind[at] == 1) & ~quoted
        near = (kind[at] == 2) & ~quoted
        plain = np.flatnonzero(~quoted)
        close = np.zeros(len(at), bool)
        if len(plain) > 1:
            beside = (np.diff(at[plain]) <= CONTEXT) & (np.diff(text[plain]) == 0)
            close[plain[1:][beside]] = True
        counts = lambda mask, weights=None: np.bincount(text[mask], None if weights is None else weights[mask], len(out))
        out[:, 0] = counts(exact) > 0
        out[:, 1], out[:, 2], out[:, 3], out[:, 4] = (np.log1p(counts(m)) for m in (exact, near, quoted, close))
        words = np.maximum(np.diff(first), 1)
        out[:, 5] = np.log1p(1000 * counts(exact) / words) / 3
        out[:, 6] = np.log1p(counts(exact, self.weights[entry[at]]))
        return out

    @staticmethod
    def _quoted(points, offsets, starts, ends, text) -> np.ndarray:
        """Whether each hit stands between marks of quotation of its line, or in a line that begins with ``>``."""
        out = np.zeros(len(starts), bool)
        marks = np.flatnonzero(_QUOTES[points])
        breaks = np.flatnonzero(points == 10)
        left = np.searchsorted(breaks, starts) - 1
        line = np.where(left >= 0, breaks[np.maximum(left, 0)] + 1 if len(breaks) else 0, 0)
        line = np.maximum(line, offsets[text])
        out |= points[line] == ord(">")
        if len(marks):
            right = np.searchsorted(breaks, ends)
            end = np.minimum(np.where(right < len(breaks), breaks[np.minimum(right, len(breaks) - 1)] if len(breaks) else len(points), len(points)), offsets[text + 1])
            before = np.searchsorted(marks, starts) - np.searchsorted(marks, line)
            after = np.searchsorted(marks, end) - np.searchsorted(marks, ends)
            out |= (before % 2 == 1) & (after > 0)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))


def learn_words(texts: DataFrame) -> list[tuple[str, float]]:
    """Entries and weights from (i, y, x). Counting is Spark's; what returns is bounded by the evidence
    that each term needs in a sample of bounded size."""
    totals = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return []
    each = map_arrow(texts.select("y", "x"), distinct_words, "y int, w string")
    counts = each.groupBy("w").agg(F.sum("y").alias("k"), F.sum(1 - F.col("y")).alias("c"))
    stems = F.transform(F.sequence(F.lit(4), F.lit(7)), lambda n: F.when(F.length("w") > n, F.concat(F.substring("w", F.lit(1), n), F.lit("*"))))
    terms = counts.select(F.explode(F.array_compact(F.concat(F.array("w"), stems))).alias("t"), "w", "k", "c")
    terms = terms.groupBy("t").agg(F.sum("k").alias("k"), F.sum("c").alias("c"), F.count("*").alias("forms"))
    ratio = ((F.col("k") + 0.5) / (bad + 1)) / ((F.col("c") + 0.5) / (good + 1))
    # how far the split between toxic and other documents is from the sample's, as a binomial deviance: the chance of
    # such a split is about exp(-14) at the bound, small against the number of different words
    share, n = bad / (bad + good), F.col("k") + F.col("c")
    off = F.col("k") * F.log(F.col("k") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0)
    # a stem must come in several forms, else its one word is the better entry
    kept = terms.where(((~F.col("t").endswith("*")) | (F.col("forms") > 2)) & (F.col("k") >= 5) & (ratio >= 8) & (off >= 14))
    found = kept.collect()
    chosen: list[tuple[str, float]] = []
    merged: set[str] = set()
    for r in sorted(found, key=lambda r: (len(r.t.removesuffix("*")), not r.t.endswith("*"), r.t)):
        body = r.t.removesuffix("*")
        if not any(body[:n] in merged for n in range(4, 8)):
            if r.t.endswith("*"):
                merged.add(body)
            chosen.append((r.t, float(np.log((r.k + 0.5) / (bad + 1) / ((r.c + 0.5) / (good + 1))))))
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 50) -> np.ndarray:
    """Logistic weights drawn towards PRIOR, the base towards -3, by Newton's method."""
    prior = np.concatenate([PRIOR, [-3.0]])
    beta, full = prior.copy(), np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.full(len(prior), ridge)
    weight[-1] = 0.1
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        g = full.T @ (p - y) + weight * (beta - prior)
        h = (full * (p * (1 - p))[:, None]).T @ full + np.diag(weight)
        step = np.linalg.solve(h, g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train(df: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows that are not held out, half of them toxic where there are so many."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id)))
    halves = [labelled(own.where(F.col(label) == y), label, id, sample // 2) for y in (0, 1)]
    wanted = F.broadcast(halves[0].join(halves[1], "i", "left_anti").union(halves[1]))
    once = Window.partitionBy("i").orderBy(F.xxhash64("x"))
    texts = df.select(F.col(id).alias("i"), F.col(text).alias("x")).join(wanted, "i").withColumn("__r", F.row_number().over(once)).where("__r = 1").select("i", "y", "x")
    from .common import stage

    texts = stage(texts, "labelled")
    found = learn_words(texts)
    model = Model([t for t, _ in found], np.array([w for _, w in found] or [0.0]), build([t for t, _ in found]), np.concatenate([PRIOR, [-3.0]]))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = model.features(batch.column(1))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), flat], names=["y", "f"])

    rows = map_arrow(texts.select("y", "x"), read, "y int, f array<double>").toArrow()
    x = np.asarray(rows.column("f").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = np.asarray(rows.column("y"), np.float64)
    if len(np.unique(y)) == 2:
        order = np.lexsort([*x.T, y])  # sums in one order whatever the partitions were
        model.beta = fit_weights(x[order], y[order])
    return model


def scored(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted. Null and empty texts have no hits and the
    base score; a null id is not held out; rows repeated under one id each have a score. Without labels of both kinds the lexicon is
    empty and all score alike. Empty tables give no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(model.features(batch.column(2))))], names=["doc_id", "held_out", "score"])

    out = map_arrow(df.select(F.col(id).alias("doc_id"), held_out(F.col(id)).alias("held_out"), F.col(text).alias("x")), run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))
