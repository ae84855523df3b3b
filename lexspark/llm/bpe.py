"""BPE encoding by backtracking over longest token matches, and decoding by an offset table.

A word is the sequence of its UTF-8 bytes, the last of which is a symbol of its own kind (the end of a word).
An Aho-Corasick automaton over all tokens, run from the word's end to its start, gives at each place the longest
token that begins there. The encoder walks along the word: at each place it takes the longest token that may
stand beside the one before it, going on to shorter ones, and back, when none may. Two tokens may stand side by
side when merging their joined symbols leaves exactly these two; such verdicts are kept in a table. A sequence
whose neighbours are all compatible is the one that merging by rank produces, so no pair is ever merged one by
one in a word. Each place is left for good once no token fits there, which bounds the work by the length.

That rests on every token being what merging makes of its own symbols; reading a vocabulary fails where one is not.

Categories of characters are those of Unicode 16 and small letters those of Unicode 17, as the tokenizers library has them: unicodedata's,
and what these versions have added to its own. Composition (NFC) is unicodedata's.

Decoding gathers bytes out of one array of all tokens' bytes by their offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Of words already met and of pairs already judged, so many are remembered by a worker.
WORDS, PAIRS = 200_000, 100_000
LOW = 0x250
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode's White_Space; re's \s has four more
_HIGH = re.compile("[^\\x00-\u012f]")  # the small letters of all others lie below LOW


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# Letters and numbers that Unicode 16 added to 15.1, and capitals that 16 and 17 added, with their small letters.
NEW = {
    "L": [
        (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
        (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
        (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
    ],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITAL = re.compile("[" + "".join(map(chr, SMALL)) + "]")


@lru_cache(8)
def char_ranges(kind: str, below: int) -> str:
    """The characters of a category below a code point, for use inside a class."""
    has = [unicodedata.category(chr(c))[0] == kind for c in range(below)] + [False]
    edges = [c for c in range(below + 1) if has[c] != (c > 0 and has[c - 1])]
    runs = [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)] + [run for run in NEW[kind] if run[1] < below]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class Memory(dict):
    """The ids of words already met, as bytes; emptied when it is full."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = np.array(self.function(word), np.uint32).tobytes()
        return found


class Codec:
    """A vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_letters()
        self.suffix = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not self.suffix or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a BPE vocabulary with word ends and all bytes is needed")

        def symbols(token: str) -> str:
            """Bytes as characters 0-255, a byte that ends a word as 256-511."""
            ends = token.endswith(self.suffix)
            body = [letters[c] for c in (token.removesuffix(self.suffix) if ends else token)]
            return "".join(map(chr, body[:-1])) + chr(body[-1] + 256 * ends)

        self.tokens = {symbols(t): i for t, i in model["vocab"].items() if t not in {a["content"] for a in spec["added_tokens"]}}
        self.symbols = {i: s for s, i in self.tokens.items()}
        self.rank, self.made = {}, {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y = symbols(a) if a.removesuffix(self.suffix) else "", symbols(b)
            pair = (self.tokens[x], self.tokens[y])
            if pair not in self.rank:
                self.rank[pair], self.made[pair] = r, self.tokens[x + y]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._specials = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace(r"\s", _SPACES)
        # most texts hold low characters alone, for which short classes do
        self.pattern, self.low_pattern = (re.compile(pattern.replace(r"\p{L}", char_ranges("L", n)).replace(r"\p{N}", char_ranges("N", n))) for n in (0x110000, LOW))
        # reading words backwards, the longest match that ends at a place is the longest token that begins there
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for s, i in self.tokens.items():
            self.automaton.add_word(s[::-1], i)
        self.automaton.make_automaton()
        # the longest proper prefix of each token that is a token too
        self.shorter = {}
        for s, i in self.tokens.items():
            self.shorter[i] = next((self.tokens[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.tokens), -1)
        self.length = {i: len(s) for s, i in self.tokens.items()}
        odd = next((s for s, i in self.tokens.items() if self.merged(s) != [i]), None)
        if odd is not None:
            raise ValueError(f"merging does not lead to the token {odd!r}")
        self.compatible = lru_cache(PAIRS)(self._compatible)
        self.word = Memory(self._word)
        # the offset table; the file names no decoder, so tokens are spelled as the vocabulary spells them, a blank between
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        spelling = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            spelling[i] = t
        raw = [(t + " ").encode() for t in spelling]
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    # ------------------------------------------------------------- encoding

    def merged(self, symbols: str) -> list[int]:
        """Merging by rank, pair by pair: what defines the encoding. Only pairs of tokens are merged here."""
        parts = [self.tokens[c] for c in symbols]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda j: self.rank.get((parts[j], parts[j + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [self.made[parts[best], parts[best + 1]]]
        return parts

    def _compatible(self, a: int, b: int) -> bool:
        return self.merged(self.symbols[a] + self.symbols[b]) == [a, b]

    def _word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        symbols = raw[:-1].decode("latin-1") + chr(raw[-1] + 256)
        n = len(symbols)
        longest = [-1] * n
        for end, token in self.automaton.iter(symbols[::-1]):
            begin = n - 1 - end
            if longest[begin] < 0 or self.length[token] > self.length[longest[begin]]:
                longest[begin] = token
        out: list[int] = []
        open_ = bytearray(b"\x01" * (n + 1))  # places from which the rest of the word may still be reached
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                after = at + self.length[token]
                if open_[after] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return tuple(out)

    def words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if not _HIGH.search(text):
            return self.low_pattern.findall(text.lower())
        if _CAPITAL.search(text):
            text = text.translate(SMALL)
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()  # each by itself: no final sigma
        return self.pattern.findall(text)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; strings of special tokens in it become those tokens."""
        word, out, at = self.word.__getitem__, [], 0
        if self._specials is not None and "<" in text:
            for m in self._specials.finditer(text):
                out += map(word, self.words(text[at : m.start()]))
                out.append(np.array([self.special[m.group()]], np.uint32).tobytes())
                at = m.end()
            text = text[at:]
        out += map(word, self.words(text))
        return np.frombuffer(b"".join(out), np.uint32)

    # ------------------------------------------------------------- decoding

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one blank between two."""
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)][:-1].tobytes()


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id, ids array<int>. Null texts count as empty, which have no ids; rows of a null id
    or repeated under one id each have their own. Empty tables give no rows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        ids = [own.encode(t or "").astype(np.int32) for t in batch.column(1).to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], names=["doc_id", "ids"])

    return map_arrow(df.select(F.col(id).alias("i"), F.col(text).alias("x")), run, "doc_id long, ids array<int>")


def decode(df: DataFrame, path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row for each input row: doc_id, text. Null ids count as none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        texts = [own.decode(np.asarray(x.values, np.uint32) if x.is_valid else np.zeros(0, np.uint32)).decode("utf-8", "replace") for x in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(df.select(F.col(id).alias("i"), F.col(ids).alias("x")), run, "doc_id long, text string")


def round_trip(df: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_tokens, ids_sha256 (little-endian 32-bit), decoded_sha256 (UTF-8). Null texts count as
    empty, which have no ids; rows of a null id or repeated under one id each have their own. Empty tables give no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, counts, ids_sha, text_sha = codec(path), [], [], []
        for t in batch.column(1).to_pylist():
            ids = own.encode(t or "")
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(df.select(F.col(id).alias("i"), F.col(text).alias("x")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
