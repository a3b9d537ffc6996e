"""Inventories over projects, instruction files and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.text import comparable_path, decode_slug, human_bytes

# fixed values: instruction and configuration files of a project, per source: (file, kind)
PROJECT_FILES = {
    "claude": [("CLAUDE.md", "instructions")],
    "codex": [("AGENTS.md", "instructions"), (".codex/config.toml", "config")],
    "opencode": [("AGENTS.md", "instructions"), ("opencode.json", "config"), ("opencode.jsonc", "config")],
}


def projects(files: DataFrame) -> DataFrame:
    """Memory files, sessions and last activity per project, from ``files(path, size, mtime)`` metadata."""
    slug = F.regexp_extract("path", r"/projects/([^/]+)/", 1)
    is_session = F.col("path").endswith(".jsonl")
    is_memory = F.col("path").rlike(r"/projects/[^/]+/memory/.*\.md$")
    return (
        files.withColumn("slug", slug)
        .where("slug <> ''")
        .groupBy("slug")
        .agg(
            F.count(F.when(is_memory, 1)).alias("memory_count"),
            F.count(F.when(is_session, 1)).alias("session_count"),
            F.max(F.when(is_session, F.col("mtime"))).alias("last_active"),
        )
        .withColumn("display_path", decode_slug(F.col("slug")))
    )


def project_roots(paths: DataFrame) -> DataFrame:
    """Distinct absolute project roots over all path columns; the ``global`` marker is no path."""
    cols = [F.col(c) for c in paths.columns]
    rows = paths.select(F.explode(F.array(*cols)).alias("root")).select(F.trim("root").alias("root"))
    return rows.where("root <> '' and root <> 'global' and root like '/%'").distinct().orderBy("root")


def instruction_artifacts(roots: DataFrame, files: DataFrame, include_missing: bool = False) -> DataFrame:
    """Candidate files of every project root, with what exists; ``roots(source, root)``, ``files(path, size)``.

    The candidates of a source are a literal array exploded per root, not a join.
    """
    entry = "array<struct<file:string,kind:string>>"
    candidates = F.lit(None).cast(entry)
    for source, names in PROJECT_FILES.items():
        rows = F.array(*[F.struct(F.lit(n).alias("file"), F.lit(k).alias("kind")) for n, k in names])
        candidates = F.when(F.col("source") == source, rows).otherwise(candidates)
    wanted = (
        roots.select("source", "root", F.explode(candidates).alias("c"))
        .select("source", F.concat_ws("/", "root", "c.file").alias("path"), "c.kind", F.col("c.file").alias("title"))
        .dropDuplicates(["source", "path"])
    )
    joined = wanted.join(files.select("path", F.col("size").alias("found_size")), "path", "left")
    rows = joined.select(
        "source", "path", "kind", "title", F.col("found_size").isNotNull().alias("exists"), F.coalesce("found_size", F.lit(0).cast("bigint")).alias("size_bytes")
    )
    return rows if include_missing else rows.where("exists")


def project_context(projects_df: DataFrame, artifacts: DataFrame, rules: DataFrame, memories: DataFrame) -> DataFrame:
    """Per project: instruction files, own rules that are no instruction file, and memories.

    Memories bind by slug or by equal path: two equi joins, united and de-duplicated.
    ``projects_df(source, project, project_path)``.
    """
    base = projects_df.withColumn("norm", comparable_path(F.col("project_path")))
    arts = artifacts.select("source", comparable_path(F.regexp_replace("path", r"/(\.codex/)?[^/]+$", "")).alias("norm"), comparable_path(F.col("path")).alias("file"))
    per_art = arts.groupBy("source", "norm").agg(F.count("*").alias("instructions"))
    own_rules = rules.select("source", comparable_path(F.col("category")).alias("norm"), comparable_path(F.col("path")).alias("file"))
    free_rules = own_rules.join(arts.select("source", "file"), ["source", "file"], "left_anti")
    per_rule = free_rules.groupBy("source", "norm").agg(F.count("*").alias("rules"))
    mem = memories.select("source", F.col("project").alias("slug"), comparable_path(F.col("project_path")).alias("mem_norm"), "filename")
    by_slug = base.select("source", "project", "norm").join(mem.withColumn("project", F.col("slug")), ["source", "project"])
    by_path = base.select("source", "project", "norm").join(mem.withColumn("norm", F.col("mem_norm")), ["source", "norm"])
    cols = ["source", "project", "norm", "slug", "filename"]
    bound = by_slug.select(*cols).unionByName(by_path.select(*cols)).distinct()
    per_mem = bound.groupBy("source", "project", "norm").agg(F.count("*").alias("memories"))
    zero = F.lit(0).cast("bigint")
    return (
        base.join(per_art, ["source", "norm"], "left")
        .join(per_rule, ["source", "norm"], "left")
        .join(per_mem, ["source", "project", "norm"], "left")
        .select("source", "project", "project_path", *[F.coalesce(c, zero).alias(c) for c in ("instructions", "rules", "memories")])
    )


def storage_stats(files: DataFrame, preserved: list[str] | None = None) -> DataFrame:
    """Files and bytes per top folder of ``files(tree, path, size)``, without preserved paths."""
    rows = files
    for keep in preserved or []:
        rows = rows.where(~((F.col("path") == keep) | F.col("path").startswith(keep + "/")))
    sums = rows.groupBy("tree").agg(F.count("*").alias("files"), F.sum("size").cast("bigint").alias("bytes"))
    return sums.withColumn("size_human", human_bytes(F.col("bytes")))


def snapshots(metas: DataFrame) -> DataFrame:
    """Snapshot list, newest name first; ``metas(name, content)``, content may be unreadable or null."""
    v = F.try_parse_json("content")

    def at(path: str, kind: str = "string"):
        return F.try_variant_get(v, path, kind)

    zero = F.lit(0).cast("bigint")
    return metas.select(
        "name",
        F.coalesce(at("$.created"), F.lit("")).alias("created"),
        F.coalesce(at("$.items", "bigint"), zero).alias("items"),
        F.coalesce(at("$.total_size", "bigint"), zero).alias("total_size"),
        F.coalesce(at("$.size_human"), F.lit("?")).alias("size_human"),
        at("$.note").alias("note"),
        F.col("name").startswith("auto-").alias("is_auto"),
    ).orderBy(F.col("name").desc())


def read_snapshot_metas(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "_meta.json").text(root, wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/_meta\.json$", 1).alias("name"), F.col("value").alias("content"))
