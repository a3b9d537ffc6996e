"""Dashboard aggregates over current sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.plans.scope import in_scope

# fixed value: days shown by the dashboard
ACTIVITY_DAYS = 30


def recency() -> list[Column]:
    """Newest first; ties are broken by identity so that a limit is repeatable."""
    return [F.col("modified").desc_nulls_last(), F.col("source"), F.col("session_id")]


def recent(sessions: DataFrame, limit: int) -> DataFrame:
    return in_scope(sessions).orderBy(*recency()).limit(limit)


def by_source(sessions: DataFrame) -> DataFrame:
    return (
        in_scope(sessions)
        .groupBy("source")
        .agg(F.count("*").alias("sessions"), F.max("modified").alias("last_active"))
        .orderBy("source")
    )


def source_health(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every known source, zeros for those without sessions."""
    stats = by_source(sessions)
    return sources.join(stats, "source", "left").select(
        "source", "display_name", F.coalesce("sessions", F.lit(0).cast("bigint")).alias("sessions"), "last_active"
    )


def top_projects(sessions: DataFrame, limit: int) -> DataFrame:
    path = F.when(F.col("project_path") == "", F.col("project")).otherwise(F.col("project_path"))
    return (
        in_scope(sessions)
        .groupBy(path.alias("path"))
        .agg(F.count("*").alias("sessions"), F.max("modified").alias("last_active"))
        .orderBy(F.col("sessions").desc(), F.col("last_active").desc(), "path")
        .limit(limit)
    )


def activity(sessions: DataFrame, today: Column, days: int = ACTIVITY_DAYS) -> DataFrame:
    """Sessions per day over a trailing window, days without any filled with zero."""
    counts = in_scope(sessions).groupBy(F.to_date("modified").alias("day")).agg(F.count("*").alias("n"))
    calendar = sessions.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(today, days - 1), today)).alias("day")
    )
    return calendar.join(counts, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0).cast("bigint")).alias("sessions")
    )


def browse(sessions: DataFrame, scope: str | None = None, source: str | None = None, limit: int | None = None) -> DataFrame:
    """Recency order; the snippet is the first prompt, else the project path."""
    rows = in_scope(sessions, scope, source).orderBy(*recency())
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumn("snippet", F.coalesce("first_prompt", "project_path"))
