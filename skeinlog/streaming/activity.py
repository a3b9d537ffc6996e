"""Live usage and activity over an event stream with event time ``ts``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.schemas import USAGE_COLUMNS

# fixed value: a transcript is quiet when nothing changed for this long
SETTLE = "16 seconds"


def daily_usage(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Tokens per source and day. Partial sums are built per task before the shuffle."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day"), "source")
        .agg(F.count("*").alias("turns"), *[F.sum(c).cast("bigint").alias(c) for c in USAGE_COLUMNS if c in stream.columns])
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "source", "turns", *[c for c in USAGE_COLUMNS if c in stream.columns])
    )


def sliding_activity(stream: DataFrame, width: str = "7 days", step: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Events in a trailing window that moves in steps."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width, step))
        .agg(F.count("*").alias("events"))
        .select(F.date_format("window.start", "yyyy-MM-dd").alias("from_day"), F.date_format("window.end", "yyyy-MM-dd").alias("to_day"), "events")
    )


def settled(stream: DataFrame, key: str, gap: str = SETTLE, lateness: str = "0 seconds") -> DataFrame:
    """Bursts of a key that have been quiet for ``gap``; emitted once, when the watermark has passed them."""
    return (
        stream.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), key)
        .agg(F.count("*").alias("changes"))
        .select(key, F.col("w.start").alias("first_change"), F.col("w.end").alias("quiet_at"), "changes")
    )


def counters_into(path: str, keys: list[str], order: str):
    """foreachBatch writer of cumulative counters that keeps no state: a batch adds one row per key, its counter at the highest position.

    The log is merged on read by ``sinks.latest(log, keys, [order])`` and may be compacted, so a key that is never heard of again costs its
    stream nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.max(order).alias(order), F.max_by("usage", order).alias("usage")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_counters(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Cumulative counters: the value at the highest position wins, whatever batch it arrives in."""
    return stream.groupBy(*keys).agg(F.max(order).alias(order), F.max_by("usage", order).alias("usage"))
