"""Readers for the given tables, and for line and store tables derived from them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from skeinlog.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by some columns over all shuffle partitions. Without the number Spark puts small partitions together by their bytes.

    For narrow rows that become many long ones: what a row group of the given tables holds is read by one task, which would then make and write all of
    them, and as they pack well into one row group again, every later scan would be one task as well.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


# For many small files: a local file system else puts a checksum file beside every one, and where Hadoop's native library is missing it starts a process
# for the permissions of either, which takes longer than writing. Other file systems do not look at it.
WITHOUT_CHECKSUMS = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is still there; scratch folders may be cleared between queries."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


_written: dict[tuple[str, str, str], tuple[str, object]] = {}


def stored(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write a derived table once per application, into the shared folder, and read it from there.

    It stands for the transcript store a deployment would already have.
    """

    @functools.wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir, f"{build.__module__}.{build.__name__}")
        if key not in _written or not exists(spark, _written[key][0]):
            df = build(spark, sf_dir)
            path = scratch_path(spark, build.__name__.replace("_", "-"))
            df.write.parquet(path)
            _written[key] = (path, df.schema)
        path, schema = _written[key]
        return spark.read.schema(schema).parquet(path)

    return read
