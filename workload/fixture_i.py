"""Line and store tables of all sources under one index; some sessions lie in snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.plans import documents as D
from skeinlog.plans import segments as G
from skeinlog.session import cut_lineage, scratch_path
from skeinlog.sources import dialect_b, dialect_c
from skeinlog.streaming import ingest, sinks
from skeinlog.streaming.refresh import refresh_into
from workload import fixture_a, fixture_b, fixture_cd
from workload.tables import exists, table

RUNS = 3


def number(session_id: str = "session_id") -> Column:
    """The conversation a session was made of."""
    return F.regexp_extract(session_id, r"(\d+)$", 1).cast("bigint")


def _archived(lines: DataFrame, every: int, rest: int, name: str) -> DataFrame:
    moved = F.when(number() % every == rest, F.concat(F.lit(f"{name}/"), F.col("session_id"))).otherwise(F.col("session_id"))
    return lines.withColumn("session_id", moved)


def a_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(fixture_a.lines(spark, sf_dir), 6, 5, "snap")


def d_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(fixture_cd.d_lines(spark, sf_dir), 5, 4, "old")


def unreadable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Message sessions that hold no JSON, and rollouts without a header."""
    conv, e = F.col("conv_id"), F.col("event_id")
    zero = F.lit(0).cast("bigint")
    bad = table(spark, sf_dir, "conversations").where("turn = 0 AND conv_id % 10 = 3")
    bad = bad.select(F.concat(F.lit("torn/bad"), conv.cast("string")).alias("session_id"), zero.alias("chunk"), zero.alias("off"), F.lit('{"type":').alias("line"))
    said = F.lit('{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":"no header"}]}}')
    headless = table(spark, sf_dir, "events").where("event_id % 50 = 7")
    headless = headless.select(F.concat(F.lit("rollout-x"), e.cast("string")).alias("session_id"), zero.alias("chunk"), zero.alias("off"), said.alias("line"))
    return bad, headless


SOURCES = ("claude", "pi", "codex", "opencode")


def _source(spark: SparkSession, sf_dir: str, source: str, counts: D.LineCounts | None) -> tuple[D.Parser, DataFrame]:
    """Parser of a source, and the keys of its manifest."""
    if source == "claude":
        lines = a_lines(spark, sf_dir).unionByName(unreadable(spark, sf_dir)[0])
        return D.line_parser({source: lines}, counts), lines.select("session_id")
    if source == "pi":
        lines = d_lines(spark, sf_dir)
        return D.line_parser({source: lines}, counts), lines.select("session_id")
    if source == "codex":
        lines = fixture_b.lines(spark, sf_dir).unionByName(unreadable(spark, sf_dir)[1])
        # written once: the manifest, the members of the groups and their counts are read from it
        tree = cut_lineage(dialect_b.threads(dialect_b.identities(lines)), "forest")
        files = lines.select("session_id").distinct().join(tree.select("session_id", "root_id"), "session_id", "left")
        return D.group_parser(lines, tree, counts), files.select(F.coalesce("root_id", "session_id").alias("session_id"))
    sessions, messages, parts = (t(spark, sf_dir) for t in (fixture_cd.c_sessions, fixture_cd.c_messages, fixture_cd.c_parts))
    roots = dialect_c.roots(sessions)
    return D.relation_parser(sessions, messages, parts, roots, counts), roots.select(F.col("root_id").alias("session_id"))


def add_sources(spark: SparkSession, sf_dir: str, store: G.Store, sources: Sequence[str], counts: D.LineCounts | None = None) -> None:
    """One segment over some sources, parsed by the keys of their manifests."""
    parsers, manifest = [], None
    for source in sources:
        parse, keys = _source(spark, sf_dir, source, counts)
        parsers.append(parse)
        one = keys.select(F.lit(source).alias("source"), "session_id", F.lit("1").alias("version")).distinct()
        manifest = one if manifest is None else manifest.unionByName(one)
    G.refresh(store, len(store.committed()), manifest, D.any_parser(*parsers))


def all_sources(spark: SparkSession, sf_dir: str, counts: D.LineCounts | None = None) -> G.Store:
    """One segment over all four dialects."""
    store = G.Store(spark, scratch_path(spark, "segments"))
    add_sources(spark, sf_dir, store, SOURCES, counts)
    return store


_built: dict[tuple[str, str], tuple[str, set[str]]] = {}


def all_index(spark: SparkSession, sf_dir: str, sources: Sequence[str] = SOURCES) -> G.Store:
    """The index of the sources that a question is about, built once per application; others come in later segments, when they are asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built or not exists(spark, f"{_built[key][0]}/commits"):
        _built[key] = (scratch_path(spark, "segments"), set())
    path, held = _built[key]
    store = G.Store(spark, path)
    missing = [s for s in sources if s not in held]
    if missing:
        add_sources(spark, sf_dir, store, missing)
        held.update(missing)
    return store


# --- a history of three runs: what the lines are after each, and the notices that say so ---------------


def lines_after(spark: SparkSession, sf_dir: str, run: int) -> dict[str, DataFrame]:
    """Message sessions first hold their lines up to 30; from run 1 on a part of them is whole, and tree sessions are there."""
    a, d = a_lines(spark, sf_dir), d_lines(spark, sf_dir)
    whole = (number() % 3 == 0) | (number() % 4 == 3) if run else F.lit(False)
    a = a.where((F.col("off") <= 30) | whole)
    return {"claude": a.where(number() % 10 != 7), "pi": d.where(number() % 8 != 0)} if run == RUNS - 1 else {"claude": a, "pi": d}


def notices(spark: SparkSession, sf_dir: str, run: int) -> DataFrame:
    n = number()

    def rows(source: str, lines: DataFrame, kept: Column, version: str | None) -> DataFrame:
        keys = lines.where(kept).select("session_id").distinct()
        return keys.select(F.lit(source).alias("source"), "session_id", F.lit(version).cast("string").alias("version"), F.lit(run).alias("seen"))

    a, d = a_lines(spark, sf_dir), d_lines(spark, sf_dir)
    if run == 0:
        return rows("claude", a, n % 4 != 3, "1")
    if run == 1:
        return rows("claude", a, (n % 3 == 0) | (n % 4 == 3), "2").unionByName(rows("pi", d, F.lit(True), "1"))
    # deletions, and notices that say nothing new
    return rows("claude", a, n % 10 == 7, None).unionByName(rows("pi", d, n % 8 == 0, None)).unionByName(rows("pi", d, n % 8 == 1, "1"))


def refreshed(spark: SparkSession, sf_dir: str, merge_every: int | None = None) -> G.Store:
    """The index after the notices were streamed in three runs."""
    path = scratch_path(spark, "refresh")
    store = G.Store(spark, f"{path}/index")
    for run in range(RUNS):
        part = notices(spark, sf_dir, run)
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = ingest.read_deltas(spark, f"{path}/in", part.schema)
        parser = lambda r=run: D.line_parser(lines_after(spark, sf_dir, r))
        sinks.drain(stream.writeStream.foreachBatch(refresh_into(store, parser, merge_every)), f"{path}/checkpoint")
    return store


def rebuilt(spark: SparkSession, sf_dir: str) -> G.Store:
    """The index of the last run's lines, built at once."""
    lines = lines_after(spark, sf_dir, RUNS - 1)
    store = G.Store(spark, scratch_path(spark, "segments"))
    keys = [rows.select(F.lit(s).alias("source"), "session_id", F.lit("1").alias("version")).distinct() for s, rows in lines.items()]
    G.refresh(store, 0, keys[0].unionByName(keys[1]), D.line_parser(lines))
    return store
