"""Enrichment of acts as they arrive: the incremental skip as a file stream, whose checkpoint remembers what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexspark.operators import imports
from lexspark.operators.versions import Versions


def enrich_stream(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Run the stage over all files of the source that no earlier run has taken, then stop. Each file is taken once."""
    rows = spark.readStream.schema(schema).parquet(source)
    return stage(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def import_batch(versions: Versions, acts: DataFrame, batch: int, dim: int, name: str = "acts") -> bool:
    """Import a batch of the stream `name`, once: the commit notes its number, and a batch of that number or below changes nothing. Tells whether it
    was imported."""
    streams = versions.commit_of()["notes"].get("streams", {})
    if batch <= streams.get(name, -1):
        return False
    imports.import_acts(acts.sparkSession, versions, acts, dim, notes={"streams": streams | {name: batch}})
    return True


def import_stream(spark: SparkSession, source: str, root: str, checkpoint: str, dim: int, name: str = "acts", files: int | None = None) -> StreamingQuery:
    """Import the acts (JSON, one a file) that have come into the folder since the last run, `files` a batch at most, into the store below root, then stop.

    The checkpoint fixes which files a batch number stands for, and the store's commit holds the number, so a batch that is
    run again after a crash, before or after its commit, takes effect once. Stream and checkpoint belong together: a new checkpoint needs a new name."""
    reader = spark.readStream.schema(imports.ENRICHED + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).json(source).withColumn("path", F.col("_metadata.file_path"))
    versions = Versions(spark, root)
    return rows.writeStream.foreachBatch(lambda df, batch: import_batch(versions, df, batch, dim, name)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
