"""Addresses of pages from site maps: an index names further site maps, these name pages, until nothing new is named.

Files are parsed as XML; what counts are the elements two levels below the top whose name ends in ``loc``, whatever the namespace. Names in other
places, such as those of pictures, do not count. Files are a table (loc, xml), so the work of a round is a join with it, and a map that has
been read is never read again, so indexes may name each other.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.config import Config
from lexspark.staging import arrow, staged

#: Files of a crawl at most, as configured by default.
MOST = 25000


def _read(xml: str | None, name: str) -> dict:
    """kind (index, page or unreadable) and the texts of a file."""
    try:
        root = ET.fromstring((xml or "").strip())
    except (ET.ParseError, ValueError):
        return {"kind": "unreadable", "locs": []}
    kind = "index" if root.tag.rpartition("}")[2] == "sitemapindex" else "page"
    return {"kind": kind, "locs": [e.text.strip() for above in root for e in above if isinstance(e.tag, str) and e.tag.endswith(name) and e.text and e.text.strip()]}


def items(xml: Column, name: str = "loc") -> Column:
    """A struct of kind (index, page or unreadable) and locs, the texts of elements at depth two whose name ends in `name`."""

    @arrow("struct<kind: string, locs: array<string>>")
    def run(files: pa.Array) -> pa.Array:
        return pa.array([_read(x, name) for x in files.to_pylist()], pa.struct([("kind", pa.string()), ("locs", pa.list_(pa.string()))]))

    return run(xml)


def expanded(files: DataFrame, start: str, map_prefix: str, page_prefix: str, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(pages, maps): the addresses (loc, via) of pages, each once, with the least map that names it, and the maps (loc, kind, round) that were
    asked for; kind is null for those that `files` (loc, xml) lacks.

    Of an index count the maps that begin with map_prefix and end in .xml, of a page map the pages that begin with page_prefix and end in
    .html. Maps are asked for in rounds, at most `most` in all, those of a round in the order of their addresses. Empty tables give no rows.
    """
    spark = files.sparkSession
    frontier = spark.createDataFrame([(start,)], "loc string")
    maps = pages = None
    asked, n = 0, 0
    while True:
        read = frontier.join(files.select("loc", "xml"), "loc", "left").groupBy("loc").agg(F.min("xml").alias("xml"))
        found = staged(read.withColumn("z", F.when(F.col("xml").isNotNull(), items(F.col("xml")))).select("loc", "z.kind", "z.locs", F.lit(n).alias("round")), "maps")
        maps = found if maps is None else maps.unionByName(found)
        named = found.select(F.col("loc").alias("via"), "kind", F.explode("locs").alias("loc"))
        own = named.where((F.col("kind") == "page") & F.col("loc").startswith(page_prefix) & F.col("loc").endswith(".html")).select("loc", "via")
        pages = own if pages is None else pages.unionByName(own)
        asked += found.count()
        further = named.where((F.col("kind") == "index") & F.col("loc").startswith(map_prefix) & F.col("loc").endswith(".xml")).select("loc").distinct()
        frontier = staged(further.join(maps.select("loc"), "loc", "left_anti").orderBy("loc").limit(max(0, most - asked)), "frontier")
        n += 1
        if frontier.isEmpty():
            break
    return pages.groupBy("loc").agg(F.min("via").alias("via")), maps.select("loc", "kind", "round")


def path_key(loc: Column) -> Column:
    """year/issue/document of an address: what follows ``eli/sluzbeni/``, or the numbers of a page's name, year_month_issue_document.html; else null."""
    named = r"/(\d{4})_\d{1,2}_(\d+)_(\d+)\.html$"
    eli = r"(?:^|/)eli/sluzbeni/(.+)$"
    return F.when(F.rlike(loc, F.lit(named)), F.concat_ws("/", *[F.regexp_extract(loc, named, k) for k in (1, 2, 3)])).when(F.rlike(loc, F.lit(eli)), F.regexp_extract(loc, eli, 1))


def not_fetched(pages: DataFrame, acts: DataFrame, limit: int | None = None) -> DataFrame:
    """The pages (loc) whose act is not among acts (year, issue, document). As configured, only the first `limit` addresses are looked at."""
    rows = pages.orderBy("loc").limit(limit) if limit else pages
    have = acts.select(F.concat_ws("/", "year", "issue", "document").alias("__key")).distinct()
    return rows.withColumn("__key", path_key(F.col("loc"))).join(have, "__key", "left_anti").drop("__key")


def to_fetch(files: DataFrame, acts: DataFrame, start: str, map_prefix: str, page_prefix: str, config: Config = Config()) -> DataFrame:
    """The addresses (loc, via) that a crawl fetches: those that the maps name within the configured number of requests, the first `document_limit` of
    them (all without a limit), but for those whose act is there."""
    pages, _ = expanded(files, start, map_prefix, page_prefix, config.max_requests_per_crawl)
    return not_fetched(pages, acts, config.document_limit if config.document_limit > 0 else None)
