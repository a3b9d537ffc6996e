"""A search index in immutable segments, refreshed by what changed.

Below one folder lie ``docs``, ``texts`` and ``postings``, each by (segment, source, archive_name), ``versions`` and ``tombstones`` by segment, and
``commits``. A refresh writes one segment: the sessions that changed, freshly parsed, their versions, and a tombstone for the row set every one of
them had in an older segment. The commit row is written last; readers see committed segments only, so a refresh that dies leaves
nothing, and one that is replayed overwrites its own folders or, once committed, does nothing. Readers drop the rows under a tombstone (an
anti-join with a narrow table); merging rewrites the live rows of all segments as one.
Source and archive are folders, so a question about a scope opens no other file; tokens are sorted within files, so row groups are skipped.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.functions.text import tokens
from skeinlog.plans.documents import DOC_COLUMNS, Parser, archive_part
from skeinlog.plans.incremental import manifest_diff
from skeinlog.plans.index import Index, kind_code
from skeinlog.plans.scope import archive_filter
from skeinlog.session import cut_lineage

# Raised when the layout or the tokens change; segments of another version are not read, so their sessions count as new.
SCHEMA_VERSION = 1

KEY = ["source", "session_id"]
PLACE = "segment bigint, source string, archive_name string"
SCHEMAS = {
    "docs": "session_key string, session_id string, project string, project_path string, agent_title string, first_prompt string, modified string, " + PLACE,
    "texts": "session_key string, member string, unit bigint, seq string, code int, text string, " + PLACE,
    "postings": "session_key string, code int, token string, " + PLACE,
    "versions": "source string, session_id string, session_key string, version string, segment bigint",
    "tombstones": "session_key string, dead bigint, segment bigint",
    "commits": "schema_version int, replaces array<bigint>, segment bigint",
}


@dataclass(frozen=True)
class Store:
    """Tables in segments below ``path``, with tombstones and commits; rows are told apart by ``session_key``."""

    spark: SparkSession
    path: str
    schemas: Mapping[str, str] = field(default_factory=lambda: SCHEMAS)

    def table(self, name: str) -> DataFrame:
        """All rows of a table, committed or not; none before the first segment."""
        try:
            return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schemas[name])

    def committed(self) -> list[int]:
        """Segments a reader may see: committed under the current schema version, and not merged into a later one."""
        rows = self.table("commits").where(F.col("schema_version") == SCHEMA_VERSION).collect()
        gone = {s for r in rows for s in r.replaces}
        return sorted(r.segment for r in rows if r.segment not in gone)

    def answered(self, segment: int) -> bool:
        """Whether a segment is committed, merged or not."""
        return not self.table("commits").where((F.col("segment") == segment) & (F.col("schema_version") == SCHEMA_VERSION)).isEmpty()

    def visible(self, name: str, segments: Sequence[int] | None = None) -> DataFrame:
        return self.table(name).where(F.col("segment").isin(list(self.committed() if segments is None else segments)))

    def live(self, name: str, segments: Sequence[int] | None = None) -> DataFrame:
        """Visible rows that no later segment has replaced."""
        segments = self.committed() if segments is None else segments
        dead = self.visible("tombstones", segments).select("session_key", F.col("dead").alias("segment")).distinct()
        return self.visible(name, segments).join(dead, ["session_key", "segment"], "left_anti")

    def versions(self) -> DataFrame:
        """(source, session_id, version) of every session the index holds."""
        return self.live("versions").where("version is not null").select(*KEY, "version")


def write_table(store: Store, name: str, segment: int, rows: DataFrame, partitions: Sequence[str] = (), order: Sequence[str] = (), dealt: bool = False) -> None:
    """``dealt`` rows lie in the partitions they are to be written from."""
    if order:
        # one shuffle, whose large partitions are split and small ones put together by their measured size
        rows = (rows if dealt else rows.hint("rebalance", *partitions)).sortWithinPartitions(*partitions, *order)
    rows.write.mode("overwrite").partitionBy(*partitions).parquet(f"{store.path}/{name}/segment={segment}")


SCOPE = ["source", "archive_name"]


def _postings(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (token, code, session); path, id, prompt and title count as content.

    Stored texts lie by session, so tokens that come again in one (as in the threads of a group) mostly go before the one shuffle. It deals rows by all
    columns: neither a common token nor a long session is one task.
    """
    named = F.explode(F.array("project_path", "session_id", "first_prompt", "agent_title")).alias("text")
    parts = docs.select(*SCOPE, "session_key", F.lit(0).alias("code"), named).unionByName(texts.select(*SCOPE, "session_key", "code", "text"))
    return parts.select(*SCOPE, "session_key", "code", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()


def commit(store: Store, segment: int, replaces: Sequence[int] = ()) -> None:
    row = store.spark.range(1).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.array(*[F.lit(s).cast("bigint") for s in replaces]).cast("array<bigint>").alias("replaces"))
    row.write.mode("overwrite").parquet(f"{store.path}/commits/segment={segment}")


TABLE_ORDER = {"docs": ["session_key"], "texts": ["session_key", "member", "unit", "seq"], "postings": ["token", "session_key"]}


def changes(store: Store, manifest: DataFrame) -> DataFrame:
    """(source, session_id, version) of what a whole manifest ``(source, session_id, version)`` changes; version null for sessions that are gone."""
    diff = manifest_diff(store.versions(), manifest, tuple(KEY)).where("status <> 'unchanged'")
    return diff.select(*KEY, F.col("new_version").alias("version"))


def refresh(store: Store, segment: int, changed: DataFrame, parse: Parser) -> None:
    """Write and commit one segment for ``changed(source, session_id, version)``, one row per session; version null deletes.

    Sessions whose version the index holds already are left out, so what is delivered again is not parsed again.
    """
    if store.answered(segment):
        return
    segments = store.committed()
    held = store.live("versions", segments).select(*KEY, F.col("session_key").alias("held_key"), F.col("version").alias("held"), F.col("segment").alias("dead"))
    rows = changed.join(held, KEY, "left").where(~F.col("version").eqNullSafe(F.col("held")))
    stale = cut_lineage(rows.select(*KEY, "version", "held_key", "dead"), "stale")
    parsed = parse(stale.where("version is not null").select(*KEY))
    write_table(store, "docs", segment, parsed.docs.select(*DOC_COLUMNS), SCOPE, TABLE_ORDER["docs"])
    texts = parsed.texts.where(strings.trim("text") != "").select("session_key", *SCOPE, "member", "unit", "seq", kind_code("kind").alias("code"), "text")
    write_table(store, "texts", segment, texts, SCOPE, TABLE_ORDER["texts"])
    # parsed once: the documents and texts that the segment keeps are read again for its postings
    kept = [store.visible(name, [segment]).drop("segment") for name in ("docs", "texts")]
    write_table(store, "postings", segment, _postings(*kept), SCOPE, TABLE_ORDER["postings"], dealt=True)
    key = F.coalesce("held_key", F.concat("source", F.lit(":"), "session_id"))
    write_table(store, "versions", segment, stale.select(*KEY, key.alias("session_key"), "version"))
    write_table(store, "tombstones", segment, stale.where("dead is not null").select(F.col("held_key").alias("session_key"), "dead"))
    commit(store, segment)


def merge(store: Store, segment: int) -> None:
    """Rewrite the live rows of all segments as one; readers go over when its commit is written."""
    segments = store.committed()
    if store.answered(segment) or len(segments) < 2:
        return
    for name, order in TABLE_ORDER.items():
        write_table(store, name, segment, store.live(name, segments).drop("segment"), SCOPE, order)
    write_table(store, "versions", segment, store.live("versions", segments).drop("segment").where("version is not null"))
    write_table(store, "tombstones", segment, store.spark.createDataFrame([], store.schemas["tombstones"]).drop("segment"))
    commit(store, segment, segments)


def vacuum(store: Store) -> list[int]:
    """Delete the rows of segments that were merged into a later one, once no reader can still be on them; their commits stay, so replays are known."""
    seen = store.table("commits").select(F.explode("replaces").alias("segment")).distinct().collect()
    gone = sorted({r.segment for r in seen} - set(store.committed()))
    jvm, conf = store.spark._jvm, store.spark._jsc.hadoopConfiguration()
    for name in store.schemas:
        for segment in gone if name != "commits" else []:
            path = jvm.org.apache.hadoop.fs.Path(f"{store.path}/{name}/segment={segment}")
            path.getFileSystem(conf).delete(path, True)
    return gone


def source_failures(store: Store) -> DataFrame:
    """(source, archive_name, docs, failed): sessions that gave a document, and sessions that were read and gave none."""
    found = store.live("docs").select("session_key", F.lit(True).alias("found"))
    rows = store.live("versions").where("version is not null").join(found, "session_key", "left")
    given = F.count(F.col("found")).alias("docs")
    return rows.groupBy("source", archive_part(F.col("session_id")).alias("archive_name")).agg(given, F.count(F.when(F.col("found").isNull(), 1)).alias("failed"))


def open_index(store: Store, archive_scope: str | None = "all", source: str | None = None) -> Index:
    """The index of a scope; the scope is a partition filter on all three tables."""
    segments = store.committed()

    def rows(name: str) -> DataFrame:
        kept = store.visible(name, segments).where(archive_filter(archive_scope))
        kept = kept if source is None else kept.where(F.col("source") == source)
        dead = store.visible("tombstones", segments).select("session_key", F.col("dead").alias("segment")).distinct()
        return kept.join(dead, ["session_key", "segment"], "left_anti").drop("segment")

    # search orders the texts of a session by (unit, seq); the member comes first
    texts = rows("texts").withColumn("unit", F.struct("member", "unit"))
    return Index(rows("docs"), texts, rows("postings"))
