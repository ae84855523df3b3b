"""Sources and sinks of acts: site maps, pages, JSON trees."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import clean_html, decode_references
from lexspark.staging import arrow

RAW = "dio string, vrsta string, izdanje string, izdanjeUrl string, brojDokumenta string, stranica string, donositelj string, datum string, eli string, eliUrl string, naslov string, doc string"


def site_map(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, loc) of XML files: kind is 'index' where a file lists site maps, else 'page'."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml").select(F.col("_metadata.file_path").alias("path"), "value")
    return locations(files, F.col("value"), "path")


def locations(df: DataFrame, xml: Column, *keep: str) -> DataFrame:
    """The texts of all elements named ``loc``, whatever the namespace prefix: character references are decoded, and CDATA is read."""
    kind = F.when(F.rlike(xml, F.lit(r"<(?:[A-Za-z]+:)?sitemapindex\b")), "index").otherwise("page")
    found = F.regexp_extract_all(xml, F.lit(r"<(?:[A-Za-z]+:)?loc>\s*((?:<!\[CDATA\[(?:(?!\]\]>)[\s\S])*\]\]>|[^<])*?)\s*</"), F.lit(1))
    plain = F.transform(found, lambda x: F.when(x.startswith("<![CDATA["), F.trim(F.regexp_replace(x, r"^<!\[CDATA\[|\]\]>$", ""))).otherwise(decode_references(x)))
    return df.select(*keep, kind.alias("kind"), F.explode(plain).alias("loc"))


def wanted(locs: DataFrame, map_prefix: str, page_prefix: str) -> DataFrame:
    index = (F.col("kind") == "index") & F.col("loc").startswith(map_prefix) & F.col("loc").endswith(".xml")
    page = (F.col("kind") == "page") & F.col("loc").startswith(page_prefix) & F.col("loc").endswith(".html")
    return locs.where(index | page)


def cached_addresses(spark: SparkSession, path: str, collect: Callable[[], DataFrame]) -> DataFrame:
    """The addresses (loc) kept below path; where nothing is kept yet, those that collect() gives, written there first."""
    try:
        return spark.read.schema("loc string").json(path)
    except AnalysisException:
        collect().select("loc").write.json(path)
    return spark.read.schema("loc string").json(path)


def read_acts(spark: SparkSession, path: str, schema: str = RAW, tolerant: bool = True) -> DataFrame:
    """A tree of JSON files, one act each, with its path; unreadable ones have a _corrupt_record, or stop the job."""
    own = schema + (", _corrupt_record string" if tolerant else "")
    rows = spark.read.schema(own).option("multiLine", True).option("mode", "PERMISSIVE" if tolerant else "FAILFAST")
    return rows.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path).withColumn("path", F.col("_metadata.file_path"))


def located(df: DataFrame) -> DataFrame:
    """Acts with an identifier or its address, neither of them blank, and the parts of the path that it names: the
    identifier's, else that of the address. What lies between the issue and the last part belongs to no folder here."""
    name = F.nullif(F.col("eli"), F.lit(""))
    if "eliUrl" in df.columns:
        name = F.coalesce(name, F.nullif(F.col("eliUrl"), F.lit("")))
    parts = F.split(F.regexp_replace(name, "^(?:https?://[^/]+)?/?eli/sluzbeni/", ""), "/")
    return df.where(name.isNotNull()).withColumns({"year": F.try_element_at(parts, F.lit(1)), "issue": F.try_element_at(parts, F.lit(2)), "document": F.try_element_at(parts, F.when(F.size(parts) > 2, -1).otherwise(F.lit(3)))})


def write_acts(df: DataFrame, path: str, form: str = "parquet") -> None:
    located(df).write.mode("overwrite").partitionBy("year", "issue").format(form).save(path)


def write_act_files(df: DataFrame, path: str) -> None:
    """A folder for each act, year/issue/document, with one JSON file; whatever stood under the path before is removed."""
    parts = ["year", "issue", "document"]
    located(df).repartition(*parts).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*parts).json(path)


def act(spark: SparkSession, path: str, eli: str, form: str = "parquet") -> DataFrame:
    """One act, read from the one partition that its identifier names."""
    year, issue = eli.removeprefix("/").removeprefix("eli/sluzbeni/").split("/")[:2]
    return spark.read.format(form).load(path).where((F.col("year") == year) & (F.col("issue") == issue) & (F.col("eli") == eli))


VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SILENT = frozenset(("head", "script", "style", "template"))


class _Blocks(HTMLParser):
    """Texts of the direct children of the first container element; a block tag ends an open paragraph."""

    def __init__(self, container: str | None):
        """Without a container the children are those of the page itself."""
        super().__init__(convert_charrefs=True)
        self.container, self.depth, self.stack, self.out, self.text, self.done = container, None if container else 0, [], [], [], False

    def handle_starttag(self, tag, attrs):
        if self.done or not self.container and tag in ("html", "body"):
            return
        if tag in BLOCK and "p" in self.stack and (self.depth is None or self.stack.index("p") >= self.depth):
            self.handle_endtag("p")
        if self.depth is not None and len(self.stack) == self.depth:
            self.text = []
        if tag in VOID:
            return
        self.stack.append(tag)
        if self.depth is None and tag == self.container:
            self.depth = len(self.stack)

    def handle_endtag(self, tag):
        if self.done or tag not in self.stack:
            return
        at = len(self.stack) - 1 - self.stack[::-1].index(tag)
        if self.depth is not None and at >= self.depth and any(t in BLOCK for t in self.stack[at + 1 :]) and tag not in BLOCK:
            return  # an inline end tag does not end blocks opened inside it
        if self.depth is not None and at <= self.depth:
            self._close()
        del self.stack[at:]
        if self.depth is not None and len(self.stack) < self.depth:
            self.done = True

    def handle_data(self, data):
        if not self.done and self.depth is not None and len(self.stack) > self.depth and not SILENT & set(self.stack):
            self.text.append(data)

    def _close(self):
        own = " ".join(" ".join(self.text).split())
        if own:
            self.out.append(own)
        self.text = []


def html_blocks(html: Column, container: str = "div") -> Column:
    """The texts of the container's direct children that are not blank; bare text beside them is left out. The container is
    the first element of that name, else the page's body, else the page itself."""

    @arrow("array<string>")
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for page in pages.to_pylist():
            for name in (container, "body", None):
                parser = _Blocks(name)
                parser.feed(page or "")
                parser.close()
                if parser.depth is not None:
                    break
            if parser.depth is not None and not parser.done:
                parser._close()
            out.append(parser.out)
        return pa.array(out, pa.list_(pa.string()))

    return run(html)


def link(html: Column) -> Column:
    """(text, href) of the first link."""
    href = F.regexp_extract(html, r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", 1)
    return F.struct(clean_html(F.regexp_extract(html, r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", 2)).alias("text"), F.nullif(href, F.lit("")).alias("href"))
