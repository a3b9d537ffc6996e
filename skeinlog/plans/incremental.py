"""Incremental refresh: what changed between two manifests, and the merged result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_diff(previous: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("source", "key")) -> DataFrame:
    """Class of every key: new, changed, unchanged or deleted."""
    old = previous.select(*keys, F.col("version").alias("old_version"))
    new = current.select(*keys, F.col("version").alias("new_version"))
    status = (
        F.when(F.col("old_version").isNull(), "new")
        .when(F.col("new_version").isNull(), "deleted")
        .when(F.col("old_version") == F.col("new_version"), "unchanged")
        .otherwise("changed")
    )
    return new.join(old, list(keys), "full_outer").withColumn("status", status)


def stale_keys(diff: DataFrame, keys: tuple[str, ...] = ("source", "key")) -> DataFrame:
    return diff.where("status in ('new', 'changed')").select(*keys)


def merge(previous: DataFrame, parsed: DataFrame, current: DataFrame, keys: tuple[str, ...] = ("source", "key")) -> DataFrame:
    """Freshly parsed rows, else the previous row of a key that is still there; vanished keys drop out."""
    k = list(keys)
    alive = current.select(*k)
    kept = previous.join(alive, k, "left_semi").join(parsed.select(*k), k, "left_anti")
    return parsed.join(alive, k, "left_semi").unionByName(kept)


def fingerprint(files: DataFrame) -> DataFrame:
    """Cheap change mark over ``files(path, size, mtime)``, and ``host`` if there; a sum, so that equal files of two hosts do not cancel."""
    facts = [c for c in ("host", "path", "size", "mtime") if c in files.columns]
    return files.agg(
        F.count("*").alias("files"),
        F.max("mtime").alias("latest"),
        F.sum(F.xxhash64(*facts).cast("decimal(20,0)")).alias("paths"),
    )
