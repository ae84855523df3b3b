"""Small tables with awkward rows, and brute-force restatements that the operators are held against."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, texts, ids=None, extra=None):
    """A documents table of the texts; extra: further columns, name -> value."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "src", None if t is None else len(t), *(extra or {}).values()) for i, t in zip(ids, texts, strict=True)]
    schema = SCHEMA + "".join(f", `{k}` string" for k in extra or {})
    return spark.createDataFrame(rows, schema)


def invented(n, seed=7, words=60, vocabulary=400):
    draw = random.Random(seed)
    return [" ".join(f"w{draw.randrange(vocabulary)}" for _ in range(draw.randrange(1, words))) for _ in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)
