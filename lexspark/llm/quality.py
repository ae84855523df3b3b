"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Features are counts and shares read off a text. Each is cut into bins at quantiles of the training rows. Boosting
goes round the features in a cycle; each turn fits a shallow tree on one feature's bins to the gradient and adds
a small part of it to that feature's lookup table. Then the pairs of features that best explain the rest get
tables of their own in the same way. A score is a sum of looked-up values, added up a batch at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, map_arrow

#: At most so many labelled rows are used in a fit, those of the least hashes of their ids.
SAMPLE = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "exclaim", "pipes", "marks", "stops", "wide", "spaces",
    "distinct", "commonest", "pairs_again", "lines_again", "shouted", "marked", "line_words",
)


def _members(*spans) -> np.ndarray:
    out = np.zeros(256)
    for s in spans:
        out[[ord(c) for c in s] if isinstance(s, str) else s] = 1
    return out


_KINDS = np.stack([_members(range(65, 91)), _members("0123456789"), _members("!"), _members("|"), _members("#$%&*@^~_=+<>{}[]\\"), _members(".,;:"), _members(range(128, 256)), _members(range(9, 14), " ")], axis=1)
_UPPER, _MARK = _members(range(65, 91)) > 0, _members("#$%&*@^~_=+<>{}[]\\!|") > 0


def features(column: pa.Array) -> np.ndarray:
    """Texts x FEATURES; a null or empty text has zeros. Whole texts are read."""
    words = Words(column)
    out = np.zeros((len(words), len(FEATURES)))
    data, starts, ends = words.data, words.starts, words.ends
    upper, mark = (_UPPER[data[starts]], _MARK[data[ends - 1]]) if len(starts) else (np.zeros(0, bool),) * 2
    if len(starts):
        upper &= _UPPER[data[np.minimum(starts + 1, ends - 1)]]
    for j in range(len(words)):
        a, b = int(words.offsets[j]), int(words.offsets[j + 1])
        lo, hi = int(words.first[j]), int(words.first[j + 1])
        if a == b:
            continue
        n, m = b - a, hi - lo
        counts = np.bincount(data[a:b], minlength=256)
        row = out[j]
        row[0], row[1], row[2] = np.log(n), np.log1p(m), n / max(m, 1)
        row[3:11] = counts @ _KINDS / n
        if not m:
            continue
        own = words.hashes[lo:hi]
        alone = np.sort(own)
        runs = np.diff(np.flatnonzero(np.concatenate([[True], alone[1:] != alone[:-1], [True]])))
        row[11], row[12] = len(runs) / m, runs.max() / m
        if m > 1:
            pairs = np.sort(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:])
            row[13] = (pairs[1:] == pairs[:-1]).sum() / (m - 1)
        lines = data[a:b].tobytes().split(b"\n")
        row[14] = 1 - len(set(lines)) / len(lines)
        row[15], row[16] = upper[lo:hi].mean(), mark[lo:hi].mean()
        row[17] = m / len(lines)
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    planes: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        if self.pairs:
            bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p}
            for (a, b), plane in zip(self.pairs, self.planes, strict=True):
                total += plane[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """A tree of that depth over ordered bins with gradients g and curvatures h, as one value per bin."""
    best = -g.sum() / (h.sum() + ridge)
    out = np.full(len(g), best)
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    cut = int(gain.argmax())
    if gain[cut] > 1e-9:
        out[: cut + 1] = _tree(g[: cut + 1], h[: cut + 1], depth - 1, ridge)
        out[cut + 1 :] = _tree(g[cut + 1 :], h[cut + 1 :], depth - 1, ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best two-way cut of a plane of bins into four leaves: its gain and values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    g1, h1 = cg[:-1, :-1], ch[:-1, :-1]
    g2, h2 = cg[:-1, -1:] - g1, ch[:-1, -1:] - h1
    g3, h3 = cg[-1:, :-1] - g1, ch[-1:, :-1] - h1
    g4, h4 = cg[-1, -1] - g1 - g2 - g3, ch[-1, -1] - h1 - h2 - h3
    gain = sum(a**2 / (b + ridge) for a, b in ((g1, h1), (g2, h2), (g3, h3), (g4, h4)))
    r, c = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for rows, cols, a, b in ((slice(0, r + 1), slice(0, c + 1), g1, h1), (slice(0, r + 1), slice(c + 1, None), g2, h2), (slice(r + 1, None), slice(0, c + 1), g3, h3), (slice(r + 1, None), slice(c + 1, None), g4, h4)):
        out[rows, cols] = -a[r, c] / (b[r, c] + ridge)
    return float(gain[r, c] - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.15, bins: int = 32, pairs: int = 6, ridge: float = 5.0) -> Model:
    """Fit on rows x features and labels 0/1. Without rows all scores are 0.5; with one label, near that label."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    edges = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    coarse = [_cuts(x[:, j], bins // 4) for j in range(x.shape[1])]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Model(base, edges, tables, coarse, [], [])
    if len(np.unique(y)) < 2:
        return model
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, b in enumerate(fine):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])), 2, ridge)
            tables[j] += step
            total += step[b]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def plane(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = sorted(((_quarters(plane(a, b, g), plane(a, b, h), ridge)[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    model.planes = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(rounds // 2):
        for (a, b), own in zip(model.pairs, model.planes, strict=True):
            g, h = slopes()
            step = rate * _quarters(plane(a, b, g), plane(a, b, h), ridge)[1]
            own += step
            total += step[rough[a], rough[b]]
    return model


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, label: str, id: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(i, y) of at most `sample` labelled ids, none of them held out; an id of two labels counts as the larger."""
    own = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~held_out(F.col(id)))
    own = own.groupBy(F.col(id).alias("i")).agg(F.max(label).cast("int").alias("y"))
    return own.orderBy(F.xxhash64("i"), "i").limit(sample)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text", sample: int = SAMPLE, **options) -> Model:
    """A model from the labelled rows that are not held out. The sample has a fixed bound, so it can be broadcast,
    and its features can come to the driver; texts never do."""
    wanted = F.broadcast(labelled(labels, label, id, sample))
    rows = df.select(F.col(id).alias("i"), F.col(text).alias("x")).join(wanted, "i")

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(2))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["i", "y", "f"])

    found = map_arrow(rows.select("i", "y", "x"), read, "i long, y int, f array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("f").alias("f"))
    found = found.orderBy("i").toArrow()
    x = np.asarray(found.column("f").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, np.asarray(found.column("y"), np.float64), **options)


def score(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))

    return run(text)


def scored(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted. Null and empty texts get a score as well;
    a null id is not held out; rows repeated under one id each have a score. Neither id nor label is an input of a score. Empty tables give
    no rows."""
    from .common import small_batches

    small_batches(df.sparkSession)
    out = df.select(F.col(id).alias("doc_id"), held_out(F.col(id)).alias("held_out"), score(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


def keep_good(df: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """df without the rows that the model rejects; all columns stay, and repeated rows are judged alike. Empty tables give no rows."""
    from .common import small_batches

    small_batches(df.sparkSession)
    return df.where(score(model, F.col(text)) >= least)
