"""Session set-up and the shared scratch location used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster deployment should carry as well; none of them depends on the data size.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # lines and texts grow many times their stored size once they are parsed or cut into words
    "spark.sql.files.maxPartitionBytes": "32m",
    # as many small files a task as with Spark's own sizes
    "spark.sql.files.openCostInBytes": "1m",
    # folders are listed many to a task; by default every folder of a tree is a task, which costs more than its listing
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # the JVM does not compile methods beyond 8000 bytes; wide CASE projections then run faster split up
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(cpus: int | str = "*", app: str = "skeinlog", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )


def tune(spark: SparkSession) -> None:
    """Apply the recommended settings to a running session."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    created = tempfile.mkdtemp(prefix="skeinlog-")
    spark.sparkContext.setCheckpointDir(created)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/skeinlog-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and read it back.

    Unlike an executor-local checkpoint the rows survive executor loss, and the reader gets real file
    sizes, so later joins are planned from facts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
