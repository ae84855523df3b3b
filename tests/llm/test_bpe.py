from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from lexspark.llm import bpe, queries

from .helpers import documents

TEXTS = [
    "", None, "İΣΑΣ ΑΣ", "'s's 'LL it'S don't", "áb é", "<|endoftext|> x <|ENDOFTEXT|> <|startoftext|>y", "x" * 3000, "ab" * 2000,
    "  a\u0085b\x1cc", "१२३ ½ Ⅷ 你好世界 🎉🎉👩‍👩‍👧 ﬁ ǅ ẞ ŉ", "​﻿\x01", "ſtraße K Å", "word " * 20_000, " \n\t",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.word_bpe())


def random_texts(n):
    draw = random.Random(1)
    spans = [(32, 127), (160, 0x250), (0x300, 0x500), (0x900, 0xA00), (0x4E00, 0x4F00), (0x1F300, 0x1F700), (0x1E00, 0x2200), (1, 0xD7FF)]
    out = ["".join(chr(draw.randrange(*draw.choice(spans))) for _ in range(draw.randrange(1, 30))) for _ in range(n)]
    parts = ["the", "er", "ing", "tion", "a", "b", "q", "z", "xx", "st", "re", "ss", "mm", "'"]
    return out + [" ".join("".join(draw.choices(parts, k=draw.randrange(1, 12))) for _ in range(20)) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(library):
    codec = bpe.codec(queries.word_bpe())
    for text in [*filter(None, TEXTS), *random_texts(600)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids, text[:80]
        assert codec.decode(np.array(ids, np.uint32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_every_character_alone_and_between_letters(library):
    codec = bpe.codec(queries.word_bpe())
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5000):
        text = " ".join(f"a{chr(c)}b {chr(c)}" for c in points[at : at + 5000])
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(points[at])


def test_repeated_rows(spark, library):
    rows = [(1, "one two"), (1, "one two"), (None, "x"), (1, "three")]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    out = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, queries.word_bpe()).collect()]
    assert sorted(out, key=str) == sorted(((i, *expected(library, t)) for i, t in rows), key=str)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_operator(spark, library):
    df = documents(spark, TEXTS, extra={"ids": "i", "n_tokens": "0"})
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(df, queries.word_bpe()).collect()}
    assert out == {i: expected(library, t) for i, t in enumerate(TEXTS)}
    ids = bpe.encode(df, queries.word_bpe())
    assert {r.doc_id: r.ids for r in ids.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in bpe.decode(ids, queries.word_bpe()).collect()}
    assert all(back[i] == library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t in enumerate(TEXTS))
    assert bpe.round_trip(df.limit(0), queries.word_bpe()).count() == 0


def test_whole_table(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_backtracking_bpe(spark, sf_dir).collect()}
    assert out == {i: expected(library, t) for i, t in docs.items()}
