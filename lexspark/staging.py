"""Tables written into the folder that driver and executors share and read again, so a lost executor costs no lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset a local master gets a temporary one, and any other is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexspark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written once and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, *works: Callable) -> list:
    """What the functions give, in their order, their jobs run side by side under this thread's tags. If one fails, the others still come to their end
    before its error is raised."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, len(works))) as pool:
        running = [pool.submit(wrap(work) if callable(wrap) else work) for work in works]
    return [each.result() for each in running]


#: Rows and bytes of an Arrow batch handed to Python.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Lower the rows and bytes of an Arrow batch where the session allows more: a worker holds a batch several times over (as Arrow, as strings, and what is made of
    them), and texts and pages can be long."""
    for key, most, default in (("maxRecordsPerBatch", rows, "10000"), ("maxBytesPerBatch", size, "67108864b")):
        key = "spark.sql.execution.arrow." + key
        now = int(spark.conf.get(key, default).removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def arrow(kind: str) -> Callable:
    """F.arrow_udf in small batches: how each Arrow function of the engine is declared."""

    def declared(function: Callable):
        small_batches(SparkSession.active())
        return F.arrow_udf(function, kind)

    return declared
