"""Listing, lexical, semantic, hybrid and fuzzy search over a documents table, with paging.

Rows come out in order; top-k parts are planned as TakeOrderedAndProject. `datum` is a string (d.m.yyyy.) and is
ordered as one, as the stored pages are; pass order="publication_date" for time. Nulls of descending orders come
first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from lexspark.functions import fuzzy as fuzzy_texts
from lexspark.functions import text as T
from lexspark.staging import arrow

from .deadline import within
from .index import newest_first


@dataclass(frozen=True)
class Request:
    """A search request, checked when it is made."""

    query: str
    search_type: str = "hybrid"
    vrsta: str | None = None
    izdanje: str | None = None
    page: int = 1
    page_size: int = 10

    def __post_init__(self):
        if not self.query:
            raise ValueError("a query has one character at least")
        if self.search_type not in ("lexical", "semantic", "hybrid"):
            raise ValueError("search_type is lexical, semantic or hybrid")
        check_page(self.page, self.page_size)


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page is 1 or more, page_size 1 to 100")


def like(text: str) -> str:
    """The pattern of a user's string: % and _ stay wildcards, a backslash is itself."""
    return "%" + text.replace("\\", "\\\\") + "%"


def newest(order: str = "datum", id: str = "id") -> list[Column]:
    return [F.col(order).desc_nulls_first(), F.col(id).desc()]


def page_of(df: DataFrame, page: int, page_size: int, order: list[Column]) -> DataFrame:
    check_page(page, page_size)
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def totals(df: DataFrame, page_size: int) -> DataFrame:
    """total and pages, the latter 1 at least."""
    return df.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long").alias("pages"))


def filtered(df: DataFrame, vrsta: str | None = None, izdanje: str | None = None) -> DataFrame:
    for column, value in (("vrsta", vrsta), ("izdanje", izdanje)):
        if value:
            df = df.where(F.col(column).ilike(like(value)))
    return df


def lexical(df: DataFrame, query: str, vrsta: str | None = None, izdanje: str | None = None) -> DataFrame:
    p = like(query)
    return filtered(df.where(F.col("naslov").ilike(p) | F.col("doc_cleaned").ilike(p)), vrsta, izdanje)


def results(df: DataFrame, kind: str = "lexical", score: Column | None = None) -> DataFrame:
    return df.select("id", "eli", (F.lit(None).cast("double") if score is None else score).alias("score"), F.lit(kind).alias("match_type"))


def by_eli(df: DataFrame, eli: str) -> DataFrame:
    """The act of an identifier as it stands in an address, percent-encoded or not."""
    return df.where(F.col("eli") == unquote(eli))


def preview(info: DataFrame) -> DataFrame:
    """Of each document's key information the first three subjects and the first two deadlines; none are empty lists."""
    first = lambda name, n: F.slice(F.coalesce(name, F.array().cast("array<string>")), 1, n).alias(name)
    return info.select("document_id", F.struct(first("subjects", 3), first("deadlines", 2)).alias("key_info_preview"))


def suggest(df: DataFrame, query: str, limit: int = 8) -> DataFrame:
    if not query or not 1 <= limit <= 20:
        raise ValueError("a query of one character at least, and a limit of 1 to 20")
    return df.where(F.col("naslov").ilike(like(query))).orderBy(*newest()).limit(limit).select("id", "eli", "naslov")


def with_short_summary(df: DataFrame, summaries: DataFrame) -> DataFrame:
    """df with short_summary; a document's first summary of that type, null without any."""
    first = summaries.where("summary_type = 'short'").groupBy("document_id").agg(F.min(F.struct("id", "text")).alias("z"))
    return df.join(first.select(F.col("document_id").alias("id"), F.col("z.text").alias("short_summary")), "id", "left")


def fused(*ranked: DataFrame, key: str = "id", k: int = 60) -> DataFrame:
    """(key, score): reciprocal rank fusion of result lists (key, rank)."""
    rows = ranked[0].select(key, "rank")
    for other in ranked[1:]:
        rows = rows.unionByName(other.select(key, "rank"))
    return rows.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


# Fields of the fuzzy search and their weights, the threshold, the shortest run and the number of highlights, the score of
# a direct match, how many results are shown and suggested, and for how many seconds a backend is waited for.
WEIGHTS = {"naslov": 0.5, "eli": 0.2, "izdanje": 0.15, "short_summary": 0.1, "donositelj": 0.05}
THRESHOLD, RUN, MARKS, DIRECT = 0.7, 2, 3, 0.99
SHOWN, SUGGESTED, WAIT, WAIT_SUGGEST = 20, 8, 5.0, 3.0


def fuzzy_match(query: str, weights: dict[str, float] = WEIGHTS, threshold: float = THRESHOLD) -> Column:
    """A struct of score and highlights. The score is null without a match, else from 0 to 1, greater for better: one run over the letters of each field
    gives the errors with which the query stands in it and the runs of the query's letters (functions/fuzzy)."""
    names, values, total = list(weights), list(weights.values()), sum(weights.values())

    @arrow("score double, highlights array<string>")
    def run(*columns: pa.Array) -> pa.Array:
        scores, marks = fuzzy_texts.weighted([c.to_pylist() for c in columns], [w / total for w in values], query, threshold, RUN, MARKS)
        found = pa.array(1 - scores, pa.float64(), mask=np.isnan(scores))
        return pa.StructArray.from_arrays([found, pa.array(marks, pa.list_(pa.string()))], ["score", "highlights"])

    return run(*[F.col(n) for n in names])


def fuzzy(index: DataFrame, query: str, threshold: float = THRESHOLD, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The rows of the index that match the query in some field, with score (to six digits) and highlights."""
    own = index.withColumn("__m", fuzzy_match(query, weights, threshold))
    return own.where("__m.score is not null").withColumns({"score": F.round("__m.score", 6), "highlights": F.col("__m.highlights")}).drop("__m")


def exactly(index: DataFrame, vrsta: str | None = None, izdanje: str | None = None) -> DataFrame:
    """The browser's filters, which are exact."""
    if vrsta:
        index = index.where(F.col("vrsta") == vrsta)
    return index.where(F.col("izdanje") == T.normalize_issue(F.lit(izdanje))) if izdanje else index


def normalized_query(query: str) -> str:
    """The query without blanks at its ends; a bare or prefixed issue number as issues are written."""
    issue = re.fullmatch(r"(?:nn\s+)?(\d{1,3}/\d{4})", query.strip(), re.IGNORECASE | re.ASCII)
    return f"NN {issue[1]}" if issue else query.strip()


def fallback(index: DataFrame, query: str, vrsta: str | None = None, izdanje: str | None = None, cap: int = SHOWN) -> DataFrame:
    """(eli, rank, score, bucket, highlights) of the first `cap` results of a search in the index alone: rows whose title or summary holds the query
    though the fuzzy search passes them over (bucket 0), then what it finds, best first (bucket 1), ties in the order of the index. A blank query lists the index, unscored. The
    query is normalised first. Each row is scored once."""
    rows, q = exactly(index, vrsta, izdanje), normalized_query(query)
    none = F.array().cast("array<string>")
    if not q:
        first = rows.orderBy(*newest_first()).limit(cap).withColumns({"score": F.lit(None).cast("double"), "bucket": F.lit(0), "highlights": none})
    else:
        scored = rows.withColumn("__m", fuzzy_match(q)).withColumn("__close", F.col("__m.score").isNotNull())
        direct = F.coalesce(T.contains(F.col("naslov"), F.lit(q)), F.lit(False)) | F.coalesce(T.contains(F.col("short_summary"), F.lit(q)), F.lit(False))
        found = scored.where(F.col("__close") | direct).withColumns({"score": F.when(F.col("__close"), F.round("__m.score", 6)).otherwise(DIRECT), "bucket": F.col("__close").cast("int"), "highlights": F.when(F.col("__close"), F.col("__m.highlights")).otherwise(none)})
        first = found.orderBy("bucket", F.desc("score"), *newest_first()).limit(cap)
    order = Window.orderBy("bucket", F.desc("score"), *newest_first())  # over `cap` rows
    return first.select("eli", F.row_number().over(order).alias("rank"), "score", "bucket", "highlights")


def enriched(found: DataFrame, index: DataFrame) -> DataFrame:
    """Results joined to the index by eli, in their own order (`rank`, or else that in which they stand); those that the index lacks are dropped. highlights, match_score and match_type are
    theirs, or empty, null and 'hybrid'. Spark chooses the join by the sizes it finds."""
    own = found if "rank" in found.columns else found.withColumn("rank", F.monotonically_increasing_id())
    pick = lambda names, default: F.coalesce(*[F.col(n) for n in names if n in own.columns], default)
    cards = own.select("eli", "rank", pick(["highlights"], F.array().cast("array<string>")).alias("highlights"), pick(["match_score", "score"], F.lit(None).cast("double")).alias("match_score"), pick(["match_type"], F.lit("hybrid")).alias("match_type"))
    return index.join(cards, "eli").orderBy("rank")


def dispatched(request: Request, backend: Callable[[Request], DataFrame] | None, index: DataFrame, cap: int = SHOWN, seconds: float = WAIT) -> tuple[DataFrame, bool]:
    """(results joined to the index, whether they come from the index alone). Without a backend, or when it fails or has no
    answer within `seconds`, the index is searched. The backend's page is run here, for its failure must show; a page has 100 rows at most."""
    return search_documents(request.query, index, backend, request.vrsta, request.izdanje, request.page_size, cap, seconds, request.page, request.search_type)


def search_documents(query: str, index: DataFrame, backend: Callable[[Request], DataFrame] | None = None, vrsta: str | None = None, izdanje: str | None = None, page_size: int = SHOWN, cap: int = SHOWN, seconds: float = WAIT, page: int = 1, search_type: str = "hybrid") -> tuple[DataFrame, bool]:
    """dispatched for any query: one that no backend takes, such as a blank one, is answered from the index."""
    spark = index.sparkSession
    if backend is not None:
        try:

            def answer() -> tuple[list, StructType]:
                found = backend(Request(query, search_type, vrsta, izdanje, page, page_size))
                return found.limit(page_size).collect(), found.schema

            rows, schema = within(spark, seconds, answer)
        except Exception:
            pass
        else:
            ranked = StructType([f for f in schema if f.name != "rank"]).add("rank", LongType())
            at = [i for i, f in enumerate(schema) if f.name != "rank"]
            return enriched(spark.createDataFrame([(*[r[i] for i in at], n) for n, r in enumerate(rows)], ranked), index), False
    return enriched(fallback(index, query, vrsta, izdanje, cap).withColumn("match_type", F.lit("fallback")), index), True


def suggestions(query: str, index: DataFrame, backend: Callable[[str], DataFrame] | None = None, limit: int = SUGGESTED, seconds: float = WAIT_SUGGEST) -> DataFrame:
    """(eli, naslov) of the backend within `seconds`, else of the best fuzzy matches in the index."""
    spark = index.sparkSession
    if backend is not None:
        try:
            rows = within(spark, seconds, lambda: backend(query).select("eli", "naslov").limit(limit).collect())
            return spark.createDataFrame([tuple(r) for r in rows], "eli string, naslov string")
        except Exception:
            pass
    return fuzzy(index, query).orderBy(F.desc("score"), *newest_first()).limit(limit).select("eli", "naslov")


def highlights(text: Column, query: str, most: int = 3) -> Column:
    return F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)" + re.sub(r"([^\w\s])", r"\\\1", query)), F.lit(0)), 1, most)


def detail(documents: DataFrame, summaries: DataFrame, segments: DataFrame, info: DataFrame) -> DataFrame:
    """Documents with their children as arrays of structs: each child table is gathered once, then joined."""

    def gathered(df: DataFrame, name: str, *fields: str) -> DataFrame:
        return df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)).withColumnRenamed("document_id", "id")

    out = documents.join(gathered(summaries, "summaries", "summary_type", "text"), "id", "left")
    out = out.join(gathered(segments, "segments", "segment_order", "clanak_label", "text"), "id", "left")
    return out.join(info.withColumnRenamed("document_id", "id"), "id", "left")


def summaries_by_type(summaries: DataFrame, types: list[str]) -> DataFrame:
    return summaries.groupBy("document_id").pivot("summary_type", types).agg(F.min("text"))
