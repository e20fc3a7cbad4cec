"""Incremental ingest: files that have arrived since the last run, each taken once. An extra beside the batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def new_rows(spark: SparkSession, root: str, schema: str, file_format: str = "parquet") -> DataFrame:
    """A stream of the rows of files under root."""
    return spark.readStream.format(file_format).schema(schema).option("recursiveFileLookup", "true").load(root)


def append_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all rows that are there now, then stop; the checkpoint remembers what was taken."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
