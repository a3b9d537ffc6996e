"""Transcript files: line scan with byte offsets, manifests, archive and host tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.functions.text import tag_key
from skeinlog.operators.ordered import RunningSum, ordered_scan


def _never_cut(spark: SparkSession) -> int:
    """Bytes of a file that Spark reads in one split, however many files there are."""
    conf = spark._jsparkSession.sessionState().conf()
    return min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def scan_lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """Every line with its file, split and exact byte offset.

    Lines of one split stay in order inside a task; the offset is a running sum inside the split plus the
    total of the earlier splits, so a file of any size is read by many tasks. The split is the chunk of
    all later ordered operators, which keeps them on the same partitioning.

    Files too small to be cut have no earlier splits, so they are read once; the sizes are known from the listing, and either branch opens its own files only.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, lineSep="\n")
    size, limit = F.col("_metadata.file_size"), _never_cut(spark)
    width = (F.octet_length("line") + 1).cast("bigint")

    def rows(kept: Column) -> DataFrame:
        return raw.where(kept).select(
            F.col("_metadata.file_path").alias("file_path"),
            size.alias("file_size"),
            F.col("_metadata.file_modification_time").alias("file_mtime"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value").alias("line"),
        )

    before = Window.partitionBy("file_path").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows(size <= limit).withColumn("off", F.coalesce(F.sum(width).over(before), F.lit(0).cast("bigint")))
    cut = ordered_scan(rows(size > limit), ["file_path"], ["row"], [RunningSum("off", width, inclusive=False)])
    return whole.unionByName(cut).drop("row")


def session_lines(scanned: DataFrame, host: str | None = None) -> DataFrame:
    """Scanned lines in the shape the dialects read.

    The session id is the file stem, behind the folder of its project (``slug:stem``) and the name of its snapshot (``snapshot/...``), and tagged with
    a named host: files of one name in other projects, snapshots or on other hosts are sessions of their own.
    """
    path = logical_path(F.col("file_path"))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.jsonl$", "")
    key = F.concat_ws("/", archive_of(path), F.concat_ws(":", project_of(path), stem))
    owner = tag_key(F.lit(host).cast("string"), F.lit(None).cast("string"), key)
    return scanned.select(owner.alias("session_id"), "chunk", "off", "line")


def logical_path(path: Column) -> Column:
    """The file a path stands for: a transcript may be a folder of parts, and folders may carry the name of a partition column."""
    whole = F.regexp_replace(path, r"/part-[^/]*$", "")
    return F.regexp_replace(whole, r"/\w+=([^/]*)", "/$1")


def project_of(path: Column) -> Column:
    """Folder below ``projects/`` that a transcript lies in, null elsewhere."""
    return F.nullif(F.regexp_extract(path, r"/projects/([^/]+)/[^/]+$", 1), F.lit(""))


def archive_of(path: Column) -> Column:
    """Snapshot name of a path below ``archives/<name>/``, null for a live one."""
    return F.nullif(F.regexp_extract(path, r"/archives/([^/]+)/", 1), F.lit(""))


def manifest(files: DataFrame) -> DataFrame:
    """(key, version) from metadata only: ``size:mtime`` in seconds. ``files(path, size, mtime)``."""
    return files.select(
        F.col("path").alias("key"), F.concat_ws(":", F.col("size").cast("string"), F.unix_timestamp("mtime").cast("string")).alias("version")
    )


def content_manifest(scanned: DataFrame) -> DataFrame:
    """(key, version) that also tells an edit of equal size within the granularity of file times: ``size:microseconds:digest``.

    ``scanned`` are lines of ``scan_lines``. Every task folds the lines of its splits into one sum of digests of (offset, line) per file, and the sums are
    added up, so a file of any size is digested by many tasks.
    """
    mark = F.sum(F.xxhash64("off", "line").cast("decimal(20,0)"))
    rows = scanned.groupBy("file_path").agg(F.max("file_size").alias("size"), F.max("file_mtime").alias("mtime"), mark.alias("digest"))
    parts = [F.col("size").cast("string"), F.unix_micros("mtime").cast("string"), F.col("digest").cast("string")]
    return rows.select(F.col("file_path").alias("key"), F.concat_ws(":", *parts).alias("version"))


def read_whole(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, content) of every file below a root, each as one text."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return rows.select(logical_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_size").alias("size_bytes"), F.col("value").alias("content"))


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Path, size and modification time of every file below a root; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def group_manifest(members: DataFrame) -> DataFrame:
    """Composite version of a thread group: any change of a member changes the root's version.

    ``members(root_key, path, version)``. The version is a count and an order-free digest sum, so a group
    of any size folds map-side into one number.
    """
    return members.groupBy(F.col("root_key").alias("key")).agg(group_version().alias("version"))


def group_version() -> Column:
    """Aggregate of ``path`` and ``version``: the number of members and an order-free digest sum."""
    part = F.md5(F.encode(F.concat_ws("@", "path", "version"), "UTF-8"))
    number = F.conv(F.substring(part, 1, 12), 16, 10).cast("decimal(20,0)")
    return F.concat_ws(":", F.count("*").cast("string"), F.sum(number).cast("string"))


def host_union(parts: list[tuple[str | None, DataFrame]], tagged: tuple[str, ...] = ("project", "key", "archive_name")) -> DataFrame:
    """Union of the same relation from several hosts; keys of a named host carry its tag."""
    out = None
    for host, df in parts:
        cols = {c: tag_key(F.lit(host).cast("string"), F.lit(None).cast("string"), F.col(c)) for c in tagged if c in df.columns}
        one = df.withColumns({**cols, "host": F.lit(host).cast("string")})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
