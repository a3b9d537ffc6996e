"""Collects the registered queries of every area."""

from __future__ import annotations

import functools
import importlib

from pyspark.sql import DataFrame, SparkSession

from skeinlog.session import tune

AREAS = ["area_a", "area_b", "area_cd", "area_usage", "area_search", "area_index", "area_files", "area_corpus", "area_text", "area_stream"]


class Area:
    """Queries of one area with their DuckDB statements."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def wrap(fn):
            @functools.wraps(fn)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                tune(spark)
                return fn(spark, sf_dir)

            assert name not in self.queries, name
            self.queries[name] = run
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return wrap


def snippet_sql(text: str, query: str) -> str:
    """DuckDB expression of a snippet around the first match."""
    start = f"greatest(strpos(lower({text}), '{query}') - 41, 0)"
    end = f"least(greatest(strpos(lower({text}), '{query}') - 1, 0) + {len(query) + 100}, length({text}))"
    return (
        f"CASE WHEN {start} > 0 THEN '...' ELSE '' END || substr({text}, {start} + 1, {end} - {start}) "
        f"|| CASE WHEN {end} < length({text}) THEN '...' ELSE '' END"
    )


def _areas() -> list[Area]:
    return [importlib.import_module(f"workload.{a}").area for a in AREAS]


def queries() -> dict:
    out: dict = {}
    for a in _areas():
        out.update(a.queries)
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for a in _areas():
        out.update(a.oracles)
    return out
