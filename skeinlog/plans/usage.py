"""Token usage roll-ups over current (not archived) sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.variants import blank_to_null
from skeinlog.plans.scope import in_scope
from skeinlog.schemas import USAGE_COLUMNS

UNKNOWN_MODEL = "unknown"


def first_model(contexts: Column | str = "model_contexts") -> Column:
    """First model named by a session; sessions without one count as unknown."""
    named = F.filter(contexts, lambda c: c["model"].isNotNull())
    return F.coalesce(F.get(named, F.lit(0))["model"], F.lit(UNKNOWN_MODEL))


def _day() -> Column:
    return F.date_format("modified", "yyyy-MM-dd")


def _sums() -> list[Column]:
    return [F.count("*").alias("sessions"), *[F.sum(c).cast("bigint").alias(c) for c in USAGE_COLUMNS]]


def totals(sessions: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return in_scope(sessions).agg(*_sums()).select("sessions", *[F.coalesce(c, zero).alias(c) for c in USAGE_COLUMNS])


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("total_tokens").desc(), F.col("sessions").desc(), F.col("key").asc())


def by_source(sessions: DataFrame) -> DataFrame:
    return _ranked(in_scope(sessions).groupBy(F.col("source").alias("key")).agg(*_sums()))


def by_model(sessions: DataFrame) -> DataFrame:
    return _ranked(in_scope(sessions).groupBy(first_model().alias("key")).agg(*_sums()))


def by_project(sessions: DataFrame) -> DataFrame:
    return _ranked(in_scope(sessions).groupBy(F.col("project_path").alias("key")).agg(*_sums()))


def by_day(sessions: DataFrame) -> DataFrame:
    rows = in_scope(sessions).where("modified is not null")
    return rows.groupBy(_day().alias("key")).agg(*_sums()).orderBy("key")


def summary(sessions: DataFrame) -> DataFrame:
    """All five reports in one pass over the sessions (grouping sets), told apart by ``report``."""
    rows = in_scope(sessions).select(
        "source", first_model().alias("model"), "project_path", _day().alias("day"), *USAGE_COLUMNS
    )
    dims = ["source", "model", "project_path", "day"]
    grouped = rows.groupingSets([[], *[[F.col(d)] for d in dims]], *[F.col(d) for d in dims]).agg(
        F.grouping_id().alias("gid"), *_sums()
    )
    # grouping id bits: 1 = the column is folded away, source is the highest bit
    report = (
        F.when(F.col("gid") == 0b0111, "source")
        .when(F.col("gid") == 0b1011, "model")
        .when(F.col("gid") == 0b1101, "project")
        .when(F.col("gid") == 0b1110, "day")
        .otherwise("total")
    )
    return (
        grouped.withColumn("report", report)
        .where("not (report = 'day' and day is null)")
        .select("report", F.coalesce(*dims, F.lit("")).alias("key"), "sessions", *USAGE_COLUMNS)
    )


def discovered_models(sessions: DataFrame) -> DataFrame:
    """Distinct model names over all contexts, letter case folded (the smallest spelling is kept)."""
    models = (
        in_scope(sessions)
        .select(F.explode("model_contexts").alias("c"))
        .select(blank_to_null(F.col("c.model")).alias("model"))
        .where(F.col("model").isNotNull() & (F.col("model") != UNKNOWN_MODEL))
    )
    return models.groupBy(F.lower("model").alias("folded")).agg(F.min("model").alias("model")).orderBy("folded").select("model")
