"""Embeddings at several levels: whole documents, titles, summaries, articles.

All texts to embed become rows of one table and are encoded once. Long texts are cut at sentences into chunks of
at most `tokens` words; a text's vector is the mean of its chunks' vectors, of length one.
"""

from __future__ import annotations

import math
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.encoders import DEFAULT, Encoder
from lexspark.encoders import encoder as encoder_of
from lexspark.functions import text as T
from lexspark.functions import vectors as V
from lexspark.staging import arrow

from .summarize import packed, words

# Names of stored vectors by key; any other key is stored as summary_<key>.
TYPES = {
    "short": "summary_short", "detailed": "summary_detailed", "sto_zakon_ureduje": "summary_structured_sto_zakon_ureduje",
    "na_koga_se_odnosi": "summary_structured_na_koga_se_odnosi", "sto_uvodi_ili_mijenja": "summary_structured_sto_uvodi_ili_mijenja",
}


def type_of(key: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), F.concat(F.lit("summary_"), key))


def chunks(text: Column, tokens: int = 512) -> Column:
    """A long text's chunks; of an empty text one chunk, itself."""
    cut = packed(T.sentences(F.coalesce(text, F.lit(""))), tokens, lambda x: F.size(words(x)))
    return F.when(F.size(cut) > 0, cut).otherwise(F.array(F.coalesce(text, F.lit(""))))


#: Kinds of texts that are encoded in chunks; others are encoded as they stand, up to what the encoder takes.
LONG = ("document", "segment")


def embed(texts: DataFrame, keys: list[str], text: str, tokens: int = 512, encoder: Encoder = encoder_of(DEFAULT), long: Column | None = None) -> DataFrame:
    """(keys, embedding): a text's chunks stay in its row, so they need no shuffle to meet again, and are encoded and pooled in one pass.
    Texts for which `long` does not hold are one chunk."""

    @arrow("array<double>")
    def pooled(whole: pa.Array, many: pa.Array) -> pa.Array:
        chunked = [_packed(sentences, tokens) if sentences else [one] for one, sentences in zip(whole.to_pylist(), many.to_pylist(), strict=True)]
        ends = np.cumsum([0, *map(len, chunked)])
        # all chunks of a batch at once: the encoder takes as many at a time as it is told to
        vectors = np.asarray(encoder([c for row in chunked for c in row]), np.float64)
        out = np.zeros((len(chunked), vectors.shape[1]))
        for i, (lo, hi) in enumerate(pairwise(ends.tolist())):
            total = vectors[lo] if hi - lo == 1 else vectors[lo:hi].sum(axis=0)
            out[i] = total / (math.sqrt(total @ total) or 1.0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.reshape(-1)))

    body = F.coalesce(text, F.lit(""))
    cut = T.sentences(body) if long is None else F.when(long, T.sentences(body))
    return texts.select(*keys, pooled(body, cut).alias("embedding"))


_WORD = re.compile(r"[^\W_]+")


def _packed(sentences: list[str], tokens: int) -> list[str]:
    """chunks() of sentences that are cut already: each is counted once."""
    out, now, n = [], [], 0
    for sentence in sentences:
        own = len(_WORD.findall(sentence))
        if now and n + own > tokens:
            out.append(" ".join(now))
            now, n = [], 0
        now.append(sentence)
        n += own
    return [*out, " ".join(now)] if now else out


def levels(documents: DataFrame, articles: DataFrame | None, id: str, summaries: list[str], title: str = "naslov", text: str = "doc_cleaned") -> DataFrame:
    """(id, embedding_type, segment_order, text): everything of a document that gets a vector."""
    none = F.lit(None).cast("int").alias("segment_order")
    docs = documents.where(F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0)
    own = F.array(F.struct(F.lit("document").alias("t"), F.col(text).alias("x")), F.struct(F.lit("title").alias("t"), F.col(title).alias("x")), *[F.struct(type_of(F.lit(s)).alias("t"), F.col(s).alias("x")) for s in summaries])
    rows = docs.select(id, F.explode(own).alias("z")).select(id, F.col("z.t").alias("embedding_type"), none, F.col("z.x").alias("text")).where("text is not null")
    if articles is None:
        return rows
    return rows.unionByName(articles.select(id, F.lit("segment").alias("embedding_type"), F.col("segment_order").cast("int"), "text"))


def without_vector(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """What is known of stored vectors, not the vectors, so a scan does not read them."""
    return vectors.drop(vector)


def with_segments(vectors: DataFrame, segments: DataFrame) -> DataFrame:
    """Vectors with the segment that both their keys name; null fields where there is none."""
    own = segments.select("document_id", F.col("id").alias("segment_id"), "segment_order", "clanak_label", F.col("text").alias("segment_text"))
    return vectors.join(own, ["document_id", "segment_id"], "left")


def nearest(df: DataFrame, vector: str, query: Column | list[float], k: int, digits: int = 6, tie: str = "vec_id") -> DataFrame:
    """The k rows of greatest cosine with the query, by a top-k that sorts no more than k rows of a partition."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("score", F.round(V.cosine(F.col(vector), q), digits)).orderBy(F.desc("score"), tie).limit(k)
