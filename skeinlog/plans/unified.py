"""One relation over all dialects: each dialect contributes columns, missing ones are null."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.schemas import USAGE_COLUMNS
from skeinlog.sources import dialect_a, dialect_b, dialect_c, dialect_d


class LineDialect(Protocol):
    """What a line-based dialect module offers: plain functions from DataFrame to DataFrame."""

    SOURCE: str

    def records(self, lines: DataFrame, min_level: str = "debug") -> DataFrame: ...

    def texts(self, lines: DataFrame) -> DataFrame: ...


# line dialects by source; the relational dialect takes tables
LINE_DIALECTS = {m.SOURCE: m for m in (dialect_a, dialect_b, dialect_d)}


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for source, df in parts.items():
        one = df.withColumn("source", F.lit(source))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def usage_by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(*[F.sum(c).cast("bigint").alias(c) for c in USAGE_COLUMNS])


def records(parts: dict[str, DataFrame | tuple[DataFrame, ...]], min_level: str = "debug") -> DataFrame:
    """Timeline records of all sources under one schema: line dialects by their lines, the relational one by (messages, parts)."""
    found = {s: dialect_c.records(*rows, min_level) if s == dialect_c.SOURCE else LINE_DIALECTS[s].records(rows, min_level) for s, rows in parts.items()}
    return union_sources(found)
