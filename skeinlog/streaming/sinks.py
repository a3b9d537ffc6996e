"""Sinks and runners shared by the streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def append_log(path: str):
    """foreachBatch writer of an upsert log: one folder per batch, overwritten when a batch is retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str] = ("batch",)) -> DataFrame:
    """Current rows of an upsert log: the newest version of every key (merge on read)."""
    values = [c for c in log.columns if c not in keys]
    position = F.struct(*order)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), position).alias("v")).select(*keys, "v.*")


def compact(spark: SparkSession, log_path: str, keys: Sequence[str], out_path: str) -> None:
    """Rewrite a log as its current rows, for a log that has grown many batches; with newer batches, ``latest`` reads them again."""
    latest(spark.read.parquet(log_path), keys).write.parquet(out_path)


def drain(writer: DataStreamWriter, checkpoint: str) -> int:
    """Process what is available now, then stop; the checkpoint lets the next run go on from there.

    Returns how many rows the run left out because they came behind the watermark.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
