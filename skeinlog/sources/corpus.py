"""Markdown corpora: memories, rules and workflow files, from ``files(path, size_bytes, content)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import markdown as M
from skeinlog.functions.text import decode_slug
from skeinlog.sources.files import read_whole


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``files`` of every Markdown file below a root."""
    return read_whole(spark, root).where(F.col("path").endswith(".md"))


def _file(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def memories(files: DataFrame) -> DataFrame:
    """Files below ``<project>/memory/``."""
    in_memory = r"^(?:.*/)?([^/]+)/memory/([^/]+\.md)$"
    block = F.col("block")
    rows = files.where(F.col("path").rlike(in_memory)).withColumn("block", M.front_matter(F.col("content")))
    name = F.regexp_extract("path", in_memory, 2)
    slug = F.regexp_extract("path", in_memory, 1)
    return rows.select(
        slug.alias("project"),
        decode_slug(slug).alias("project_path"),
        name.alias("filename"),
        F.coalesce(M.field(block, "name"), F.when(block.isNull() & (name == M.MEMORY_INDEX), name)).alias("name"),
        M.field(block, "description").alias("description"),
        M.memory_type(name, block).alias("memory_type"),
        "size_bytes",
        M.body(F.col("content")).alias("body"),
    )


def rules(files: DataFrame) -> DataFrame:
    """Files below ``rules/``: category from the folder, a ``_disabled`` folder switches a rule off."""
    in_rules = r"^(?:.*/)?rules/(.*?)/?([^/]+\.md)$"
    rows = files.where(F.col("path").rlike(in_rules)).withColumn("block", M.front_matter(F.col("content")))
    folder = F.regexp_extract("path", in_rules, 1)
    block = F.col("block")
    return rows.select(
        M.rule_category(folder).alias("category"),
        _file(F.col("path")).alias("filename"),
        "path",
        M.rule_enabled(folder).alias("enabled"),
        M.field(block, "description").alias("description"),
        M.field(block, "globs").alias("globs"),
        F.coalesce(M.field(block, "alwaysApply") == "true", F.lit(False)).alias("always_apply"),
        "size_bytes",
    )


def workflows(files: DataFrame) -> DataFrame:
    """Skills (one folder each), commands, plans and tasks (flat files)."""
    skill = r"(?:^|/)skills/([^/]+)/SKILL\.md$"
    flat = r"(?:^|/)(commands|plans|tasks)/([^/]+)\.md$"
    path = F.col("path")
    is_skill = path.rlike(skill)
    kind = F.when(is_skill, "skill").otherwise(F.regexp_replace(F.regexp_extract(path, flat, 1), "s$", ""))
    name = F.when(is_skill, F.regexp_extract(path, skill, 1)).otherwise(F.regexp_extract(path, flat, 2))
    return files.where(is_skill | path.rlike(flat)).select(
        kind.alias("kind"),
        name.alias("name"),
        "path",
        M.workflow_description(F.col("content")).alias("description"),
        M.workflow_description(F.col("content"), whole=True).alias("whole_description"),
        "size_bytes",
    )


def matching_memories(rows: DataFrame, memory_type: str | None = None, query: str = "") -> DataFrame:
    if memory_type:
        rows = rows.where(F.coalesce("memory_type", F.lit("unknown")) == memory_type)
    if query:
        q = F.lit(query.lower())
        fields = [F.coalesce("name", "filename"), F.coalesce("description", F.lit("")), F.col("filename")]
        rows = rows.where(F.contains(F.lower(fields[0]), q) | F.contains(F.lower(fields[1]), q) | F.contains(F.lower(fields[2]), q))
    return rows


def matching_workflows(rows: DataFrame, kind: str | None = None, query: str = "") -> DataFrame:
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if query.strip():
        q = F.lit(query.lower())
        rows = rows.where(F.contains(F.lower("name"), q) | F.contains(F.lower("whole_description"), q))
    return rows


def type_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("memory_type", F.lit("unknown")).alias("memory_type")).agg(F.count("*").alias("memories"))


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("workflows"))
