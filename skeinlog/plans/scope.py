"""Which sessions a question is about: archive scope, source, project, capability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the known sources with their display names and whether their sessions can be searched
SOURCES = [
    ("claude", "Claude Code", True),
    ("codex", "Codex", True),
    ("opencode", "OpenCode", True),
    ("pi", "PiAgent", True),
]


def sources(spark: SparkSession, extra: list[tuple[str, str, bool]] | None = None) -> DataFrame:
    return spark.createDataFrame(SOURCES + (extra or []), "source string, display_name string, sessions_search boolean")


def archive_filter(scope: str | None):
    """current (the default, also for unknown values), all, or archived."""
    if scope == "all":
        return F.lit(True)
    if scope == "archived":
        return F.col("archive_name").isNotNull()
    return F.col("archive_name").isNull()


def in_scope(sessions: DataFrame, scope: str | None = None, source: str | None = None, project: str | None = None) -> DataFrame:
    rows = sessions.where(archive_filter(scope))
    if source is not None:
        rows = rows.where(F.col("source") == source)
    if project is not None:
        rows = rows.where((F.col("project") == project) | (F.col("project_path") == project))
    return rows


def searchable(rows: DataFrame, source_table: DataFrame) -> DataFrame:
    """Rows of sources that declare session search."""
    return rows.join(source_table.where("sessions_search").select("source"), "source", "left_semi")


def resolve_source(available: list[str], wanted: str | None) -> str:
    """An explicit source, else the first available one, else the first known one."""
    if wanted is not None:
        return wanted
    order = [s[0] for s in SOURCES]
    return next((s for s in order if s in available), order[0])
