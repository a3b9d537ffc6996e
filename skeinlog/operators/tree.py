"""Session trees: root resolution by pointer jumping, and roll-up of a group onto its root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.session import cut_lineage


def next_pointers(nodes: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id, next) of thread nodes ``(id, parent_id, root_hint, is_subagent)``; existing threads are those of ``among``, else the nodes themselves.

    A sub-agent points at its root hint when that names an existing thread that is itself no sub-agent,
    else at its parent when that exists, else nowhere. Other threads are roots.
    """
    known = (nodes if among is None else among).select(F.col("id").alias("known_id"), F.col("is_subagent").alias("known_sub"))
    hint = known.where("not known_sub").select(F.col("known_id").alias("hint_ok"))
    parent = known.select(F.col("known_id").alias("parent_ok"))
    subs = nodes.where("is_subagent")
    hinted = subs.join(hint, (F.col("root_hint") == F.col("hint_ok")) & (F.col("root_hint") != F.col("id")), "left")
    # rows with a valid hint need no parent lookup
    parent_key = F.when(F.col("hint_ok").isNull(), F.col("parent_id"))
    joined = hinted.withColumn("parent_key", parent_key).join(parent, F.col("parent_key") == F.col("parent_ok"), "left")
    pointed = joined.select("id", F.coalesce("hint_ok", "parent_ok").alias("next"))
    roots = nodes.where("not is_subagent").select("id", F.lit(None).cast(nodes.schema["id"].dataType).alias("next"))
    return roots.unionByName(pointed)


def resolve_roots(pointers: DataFrame, label: str = "roots") -> DataFrame:
    """(id, root_id) for pointers ``(id, next)`` that name existing rows.

    Each round doubles the distance a row has jumped, so a chain of depth d takes log2(d) rounds. Rows
    that reached a root leave the working set; the pointers and each round are written to the shared folder, which
    cuts the lineage and survives executor loss. A round that resolves nothing leaves only rows that run into a
    cycle, and those stand for themselves.
    """
    # roots as well: every round and every reader of the result needs them
    pointers = cut_lineage(pointers, f"{label}-0")
    done = [pointers.where("next is null").select("id", F.col("id").alias("root_id"))]
    frontier = pointers.where("next is not null")
    remaining = frontier.count()
    round_no = 0
    while remaining:
        round_no += 1
        roots = done[0] if len(done) == 1 else _union(done)
        ahead = frontier.select(F.col("id").alias("next"), F.col("next").alias("ahead")).unionByName(
            roots.select(F.col("id").alias("next"), F.lit(None).cast(frontier.schema["next"].dataType).alias("ahead"), "root_id"),
            allowMissingColumns=True,
        )
        moved = cut_lineage(frontier.join(ahead, "next"), f"{label}-{round_no}")
        done.append(moved.where("root_id is not null").select("id", "root_id"))
        frontier = moved.where("root_id is null").select("id", F.col("ahead").alias("next"))
        left = frontier.count()
        if left == remaining:
            done.append(frontier.select("id", F.col("id").alias("root_id")))
            break
        remaining = left
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
