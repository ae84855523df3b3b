"""The static search index: a slim projection, its fingerprint, and a manifest that names it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("eli", "izdanje", "naslov", "vrsta", "datum", "donositelj", "brojDokumenta", "short_summary")


#: The collation by which dates are ordered as strings: that of Unicode's root, as browsers compare strings.
COLLATION = "UNICODE"


def newest_first(collation: str = COLLATION) -> list[Column]:
    """The order of the index: `datum` as a string of the collation, descending, then eli. UTF8_BINARY orders by bytes."""
    return [F.collate(F.coalesce("datum", F.lit("")), collation).desc(), F.col("eli")]


def search_index(df: DataFrame, collation: str = COLLATION) -> DataFrame:
    """Eight fields of each document, newest `datum` first as strings go; missing titles are ''."""
    own = [F.coalesce(F.col(c), F.lit("")).alias(c) if c == "naslov" else F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in FIELDS]
    return df.where(F.col("eli").isNotNull()).select(*own).orderBy(*newest_first(collation))


def latest(index: DataFrame, n: int = 6, collation: str = COLLATION) -> DataFrame:
    return index.orderBy(*newest_first(collation)).limit(n)


def row_digest(df: DataFrame):
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]), 256)


def manifest(index: DataFrame) -> DataFrame:
    """(file, hash, count). The hash does not depend on the rows' order and is never gathered: rows' digests are
    summed by halves, so any number of tasks can add up their own, and the sums are digested."""
    d = row_digest(index)
    part = lambda at: F.sum(F.conv(F.substring("d", at, 12), 16, 10).cast("decimal(38,0)"))
    sums = index.select(d.alias("d")).agg(F.count("*").alias("count"), *[part(1 + 12 * j).alias(f"s{j}") for j in range(4)])
    text = F.concat_ws("-", F.col("count").cast("string"), *[F.coalesce(F.col(f"s{j}"), F.lit(0)).cast("string") for j in range(4)])
    return sums.select(F.left(F.sha2(text, 256), F.lit(16)).alias("hash"), "count").select(F.concat(F.lit("search-index."), "hash", F.lit(".json")).alias("file"), "hash", "count")


def _files(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_index(index: DataFrame, root: str) -> str:
    """Write the index under the name of its fingerprint, then the manifest; readers go by the manifest. Indexes of other names are removed last, so one
    that is being loaded is there until the manifest names another. An index that is there already is not written again."""
    spark, one = index.sparkSession, manifest(index)
    name = one.first()["file"]
    files, path = _files(spark, f"{root}/{name}/_SUCCESS")
    if not files.exists(path):
        index.write.mode("overwrite").json(f"{root}/{name}")
    one.withColumn("generatedAt", F.current_timestamp().cast("string")).coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    files, path = _files(spark, root)
    for status in files.listStatus(path):
        other = status.getPath().getName()
        if other.startswith("search-index.") and other != name:
            files.delete(status.getPath(), True)
    return f"{root}/{name}"


def load_index(spark, root: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in FIELDS)).json(f"{root}/{spark.read.json(f'{root}/manifest').first()['file']}")
