"""User annotations on sessions: favourite, pinned, tags, note, keyed ``source::session_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.plans.dashboard import recency

FIELDS = ["favorite", "pinned", "tags", "note"]


def clean_tags(tags: Column | str) -> Column:
    """Trimmed, without blanks, first occurrence kept."""
    trimmed = F.transform(tags, strings.trim)
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates replace rows by key; a row with nothing but defaults disappears."""
    new = updates.select("key", F.struct("favorite", "pinned", clean_tags("tags").alias("tags"), "note").alias("new"))
    old = current.select("key", F.struct(*FIELDS).alias("old"))
    merged = old.join(new, "key", "full_outer").select("key", F.coalesce("new", "old").alias("m")).select("key", "m.*")
    empty = ~F.col("favorite") & ~F.col("pinned") & (F.size("tags") == 0) & (F.coalesce("note", F.lit("")) == "")
    return merged.where(~empty)


def annotated(sessions: DataFrame, annotations: DataFrame) -> DataFrame:
    """Sessions with their annotations, pinned first, newest next."""
    key = F.concat_ws("::", "source", "session_id")
    joined = sessions.withColumn("key", key).join(annotations, "key", "left")
    filled = joined.withColumns(
        {
            "favorite": F.coalesce("favorite", F.lit(False)),
            "pinned": F.coalesce("pinned", F.lit(False)),
            "tags": F.coalesce("tags", F.expr("cast(array() as array<string>)")),
        }
    )
    return filled.orderBy(F.col("pinned").desc(), *recency())


def marked(rows: DataFrame, favorites_only: bool = False, tag: str | None = None) -> DataFrame:
    if favorites_only:
        rows = rows.where("favorite")
    if tag is not None:
        rows = rows.where(F.array_contains("tags", tag))
    return rows


def all_tags(annotations: DataFrame) -> DataFrame:
    return annotations.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("sessions")).orderBy("tag")
