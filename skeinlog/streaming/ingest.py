"""Continuous ingest of transcript lines.

Spark's file source takes a file as finished, while a transcript grows. Growth is delivered as new
micro-files that hold the appended lines with their position; a re-delivered line has the same identity
(file, offset) and is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ["file_path", "off"]


def read_deltas(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def read_text(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw text micro-files as a stream of lines with their file."""
    reader = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(path)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("line"))


def deduplicated(stream: DataFrame, event_time: str = "ts", lateness: str = "7 days") -> DataFrame:
    """Each line once, as long as its copies arrive within the lateness."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(IDENTITY)
