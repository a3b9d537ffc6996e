"""The stored thread forest: identities with their root thread, kept up by what each refresh brings.

``threads`` lies in segments as the index does. An update resolves only what new, changed or vanished files can move: a thread's pointer depends on
its own header and on whether the threads it names exist, so it can change only if one of those was touched, and a root can change only inside a
group (the threads of one root) that holds such a thread. The members of these groups are resolved again by pointer jumping; a
pointer that leaves them ends at the root stored for its target. Threads that ran into a cycle stand for themselves and belong to no group,
so they always take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators.tree import next_pointers, resolve_roots
from skeinlog.plans import segments as G
from skeinlog.session import cut_lineage

IDENTITY = (
    "session_id string, thread_id string, root_hint string, parent_id string, is_subagent boolean, cwd string, started string, provider string,"
    " agent_path string, agent_nickname string, agent_role string"
)
NAMES = [c.split()[0] for c in IDENTITY.split(", ")]
SCHEMAS = {
    "threads": f"{IDENTITY}, session_key string, next string, root_id string, segment bigint",
    "tombstones": G.SCHEMAS["tombstones"],
    "commits": G.SCHEMAS["commits"],
}


def open_forest(spark: SparkSession, path: str) -> G.Store:
    return G.Store(spark, path, SCHEMAS)


def tree(store: G.Store) -> DataFrame:
    """Identities with their root, as ``dialect_b.threads`` resolves them from nothing."""
    return store.live("threads").select(*NAMES, "root_id")


def _nodes(rows: DataFrame, *more: str) -> DataFrame:
    """One node per thread; of several files that claim one thread the first by id counts."""
    facts = F.struct("parent_id", "root_hint", "is_subagent", *more)
    return rows.groupBy(F.col("thread_id").alias("id")).agg(F.min_by(facts, "session_id").alias("n")).select("id", "n.*")


def update(store: G.Store, segment: int, identities: DataFrame, gone: DataFrame | None = None) -> None:
    """Write and commit one segment for new or changed ``identities`` and vanished sessions ``gone(session_id)``.

    A segment that is committed is not written again.
    """
    if store.answered(segment):
        return
    segments = store.committed()
    current = store.live("threads", segments)
    fresh = cut_lineage(identities.select(*NAMES), "forest-new")
    out = fresh.select("session_id")
    out = out if gone is None else out.unionByName(gone.select("session_id"))
    replaced = current.join(out, "session_id", "left_semi")
    kept = current.join(out, "session_id", "left_anti")
    rows = kept.select(*NAMES).unionByName(fresh)
    touched = cut_lineage(fresh.select(F.col("thread_id").alias("id")).unionByName(replaced.select(F.col("thread_id").alias("id"))).distinct(), "forest-touched")

    # groups that hold a thread whose pointer may change
    def named(column: str) -> DataFrame:
        return current.join(touched.select(F.col("id").alias(column)), column, "left_semi").select("root_id")

    moved = named("thread_id").unionByName(named("parent_id")).unionByName(named("root_hint"))
    moved = moved.unionByName(current.where("next is not null and root_id = thread_id").select("root_id")).distinct()
    members = current.join(moved, "root_id", "left_semi").select(F.col("thread_id").alias("id"))
    delta = cut_lineage(members.unionByName(touched).distinct(), "forest-delta")

    nodes = _nodes(rows)
    mine = nodes.join(delta, "id", "left_semi")
    pointers = cut_lineage(next_pointers(mine, nodes), "forest-pointers")
    # a pointer to a thread outside ends at its stored root, which stands in as a root of its own
    outside = current.join(delta.select(F.col("id").alias("thread_id")), "thread_id", "left_anti").groupBy(F.col("thread_id").alias("next")).agg(F.min("root_id").alias("stored"))
    ended = cut_lineage(pointers.join(outside, "next", "left").select("id", F.coalesce("stored", "next").alias("next"), F.col("next").alias("pointed"), "stored"), "forest-ended")
    stand_ins = ended.where("stored is not null").select(F.col("stored").alias("id")).distinct().withColumn("next", F.lit(None).cast("string"))
    roots = resolve_roots(ended.select("id", "next").unionByName(stand_ins), "forest").join(delta, "id", "left_semi")

    resolved = ended.select(F.col("id").alias("thread_id"), F.col("pointed").alias("next")).join(roots.withColumnRenamed("id", "thread_id"), "thread_id")
    changed = rows.join(resolved, "thread_id").select(*NAMES, F.col("session_id").alias("session_key"), "next", "root_id")
    G.write_table(store, "threads", segment, changed)
    stale = current.join(delta.select(F.col("id").alias("thread_id")), "thread_id", "left_semi").select("session_key", F.col("segment").alias("dead"))
    G.write_table(store, "tombstones", segment, stale)
    G.commit(store, segment)


def merge(store: G.Store, segment: int) -> None:
    """Rewrite the live threads as one segment, by root."""
    segments = store.committed()
    if store.answered(segment) or len(segments) < 2:
        return
    G.write_table(store, "threads", segment, store.live("threads", segments).drop("segment"), order=["root_id", "session_id"])
    G.write_table(store, "tombstones", segment, store.spark.createDataFrame([], SCHEMAS["tombstones"]).drop("segment"))
    G.commit(store, segment, segments)
