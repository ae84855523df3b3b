"""Encoders: from texts to a matrix with one row of length one for each.

An encoder by tokens gives token ids with their places in the text, and a vector for each token; `pooled` cuts texts at the
greatest number of tokens, fills batches up to their longest text, and takes the mean of the tokens' vectors under the mask. Any function from texts
to a matrix is an encoder as well. Encoders are registered by name on the driver and sent with the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from functools import partial
from typing import Protocol

import numpy as np

from lexspark.config import Config

Encoder = Callable[[list[str]], np.ndarray]


class TokenEncoder(Protocol):
    dimension: int

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids of the text's tokens, and where each begins and ends."""

    def vectors(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """texts x tokens x dimension, for ids and mask of texts x tokens; what stands where the mask is 0 does not count."""


class HashedWords:
    """Words without case as tokens, each a unit vector by its hash: no weights are needed."""

    _words = re.compile(r"[^\W_]+")

    #: Words whose hashes a worker keeps, and the longest of them.
    _most, _longest = 1 << 16, 40

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self._bins: dict[str, int] = {}

    def _bin(self, word: str) -> int:
        found = zlib.crc32(word.lower().encode()) % self.dimension
        if len(word) <= self._longest:
            if len(self._bins) >= self._most:
                self._bins.clear()
            self._bins[word] = found
        return found

    def counted(self, texts: list[str], most: int) -> np.ndarray:
        """The means of the texts' first `most` tokens as one count: no places, and words that were met before are not hashed again."""
        known, own, bins, sizes = self._bins.get, self._bin, [], []
        for text in texts:
            words = self._words.findall(text)[:most]
            sizes.append(len(words))
            bins += [b if (b := known(w)) is not None else own(w) for w in words]
        n, sizes = len(texts), np.array(sizes, np.int64)
        cells = np.repeat(np.arange(n) * self.dimension, sizes) + np.array(bins, np.int64)
        return np.bincount(cells, minlength=n * self.dimension).reshape(n, self.dimension) / np.maximum(sizes[:, None], 1e-9)

    def __getstate__(self):
        return self.__dict__ | {"_bins": {}}

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        found = [(m[0].lower(), m.span()) for m in self._words.finditer(text)]
        return [zlib.crc32(w.encode()) % self.dimension for w, _ in found], [s for _, s in found]

    def vectors(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.eye(self.dimension)[ids]


def truncated(text: str, encoder: TokenEncoder, most: int) -> str:
    """The text up to the end of its `most`-th token."""
    spans = encoder.tokens(text)[1]
    return text if len(spans) <= most else text[: spans[most - 1][1]]


def pooled(texts: list[str | None], encoder: TokenEncoder, most: int = 512, batch: int = 32) -> np.ndarray:
    """A row for each text: the mean of its first `most` tokens' vectors, of length one; zeros without tokens. `batch` texts are encoded at a time."""
    out = np.zeros((len(texts), encoder.dimension))
    for lo in range(0, len(texts), batch):
        if hasattr(encoder, "counted"):
            out[lo : lo + batch] = encoder.counted([t or "" for t in texts[lo : lo + batch]], most)
            continue
        many = [encoder.tokens(t or "")[0][:most] for t in texts[lo : lo + batch]]
        width = max(map(len, many), default=0)
        ids, mask = np.zeros((len(many), width), np.int64), np.zeros((len(many), width))
        for i, row in enumerate(many):
            ids[i, : len(row)], mask[i, : len(row)] = row, 1
        out[lo : lo + batch] = (encoder.vectors(ids, mask) * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1e-9)
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1.0)


#: The encoder that needs no registration.
DEFAULT = "hashed-64"
_KNOWN: dict[str, Encoder | TokenEncoder] = {DEFAULT: HashedWords(64)}


def register(name: str, encoder: Encoder | TokenEncoder) -> None:
    _KNOWN[name] = encoder


def encoder(name: str, most: int = 512, batch: int = 32) -> Encoder:
    """The encoder of a name, as a function of texts; one by tokens cuts texts at `most` tokens and takes `batch` texts at a time."""
    if name not in _KNOWN:
        raise ValueError(f"no encoder is registered as {name}")
    found = _KNOWN[name]
    return partial(pooled, encoder=found, most=most, batch=batch) if hasattr(found, "tokens") else found


def check_dimension(config: Config) -> None:
    """An error where the encoder of the vectors is known to be of another dimension than the one configured."""
    found = getattr(_KNOWN.get(config.encoder), "dimension", config.embedding_dim)
    if found != config.embedding_dim:
        raise ValueError(f"{config.encoder} gives {found} dimensions, {config.embedding_dim} are configured")


def warm_up(config: Config) -> list[str]:
    """Run every encoder on offer once; the names of those that are not there or fail. One failure stops no other."""
    failed = []
    for name in dict.fromkeys([config.encoder, config.summarizer, *config.encoders, *config.summarizers]):
        try:
            encoder(name)([""])
        except Exception:
            failed.append(name)
    return failed
