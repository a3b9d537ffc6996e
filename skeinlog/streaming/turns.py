"""Merging streamed assistant chunks across micro-batches.

A micro-batch may end in the middle of a message. The text a session left open is the only memory a stream needs: a row of the ``open`` table, which
lies in segments like the index and is replaced only when its session says something again. Such a row joins the next batch of its session as the first
piece; earlier pieces of a long text are final. The merge itself is the batch operator, so a hot session spreads over many tasks
here as well. A session that has been quiet for long enough is not waited for: its open text is given out and leaves the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.plans import segments as G
from skeinlog.session import cut_lineage
from skeinlog.sources import dialect_a as A

SCHEMAS = {
    "open": "session_id string, session_key string, chunk bigint, off bigint, text string, text_ts string, seen string, segment bigint",
    "clock": "now string, segment bigint",
    "tombstones": G.SCHEMAS["tombstones"],
    "commits": G.SCHEMAS["commits"],
}


def state(spark: SparkSession, path: str) -> G.Store:
    """Open texts and the newest time seen; readers of the turns at ``path`` do not list this folder."""
    return G.Store(spark, f"{path}/_state", SCHEMAS)


def _carried(rows: DataFrame, like: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast(like.schema["line"].dataType)
    return rows.select("session_id", "chunk", "off", F.col("text_ts").alias("ts"), F.col("text").alias("content"), F.lit(False).alias("closes"), nothing.alias("line"))


def merge_into(path: str, quiet: str | None = None, merge_every: int = 16):
    """foreachBatch writer: messages of a batch in one folder per batch, and the open texts of its sessions in the state.

    ``quiet`` (an interval such as ``1 hour``) is how far the newest time of the stream may run ahead of a session's last batch before its open text is given out
    as it is. A batch that is delivered again overwrites its folder, or does nothing once its state is committed. Every ``merge_every`` batches the
    state is rewritten as one segment.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, store, segment = batch.sparkSession, state(batch.sparkSession, path), 2 * batch_id
        if store.answered(segment):
            return
        segments = store.committed()
        held = store.live("open", segments)
        rows = A.turn_rows(batch)
        here = batch.select("session_id").distinct()
        carried = held.join(here, "session_id", "left_semi")
        turns = cut_lineage(A.merge_turns(rows.unionByName(_carried(carried, rows))), "turns")

        newest = turns.select(F.greatest("text_ts", "end.ts").alias("now")).unionByName(store.visible("clock", segments).select("now")).agg(F.max("now").alias("now"))
        now = newest.first().now
        waiting = held.join(here, "session_id", "left_anti")
        ran_out = F.lit(False) if quiet is None or now is None else F.to_timestamp("seen") <= F.to_timestamp(F.lit(now)) - F.expr(f"interval {quiet}")
        gone = cut_lineage(waiting.where(ran_out), "quiet")
        given = gone.select("session_id", "off", "chunk", "text", "text_ts", F.lit(None).cast(turns.schema["end"].dataType).alias("end"), F.lit(False).alias("tail"))
        turns.unionByName(given).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

        still = turns.where("tail").select("session_id", F.col("session_id").alias("session_key"), "chunk", "off", "text", "text_ts", F.lit(now).cast("string").alias("seen"))
        G.write_table(store, "open", segment, still)
        dead = carried.unionByName(gone).select("session_key", F.col("segment").alias("dead"))
        G.write_table(store, "tombstones", segment, dead)
        G.write_table(store, "clock", segment, spark.range(1).select(F.lit(now).cast("string").alias("now")))
        G.commit(store, segment)
        if (batch_id + 1) % merge_every == 0:
            _merge(store, segment + 1)

    return write


def _merge(store: G.Store, segment: int) -> None:
    segments = store.committed()
    if store.answered(segment) or len(segments) < 2:
        return
    G.write_table(store, "open", segment, store.live("open", segments).drop("segment"))
    G.write_table(store, "clock", segment, store.visible("clock", segments).agg(F.max("now").alias("now")))
    G.write_table(store, "tombstones", segment, store.spark.createDataFrame([], SCHEMAS["tombstones"]).drop("segment"))
    G.commit(store, segment, segments)


def closed_turns(spark: SparkSession, path: str) -> DataFrame:
    """Every finished message or piece of one: its text, and the call that ended it."""
    turns = spark.read.parquet(path).where("not tail")
    end = F.col("end")

    def entry(kind: str, content: Column, call: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), content.alias("content"), call.cast("string").alias("tool_use_id"))

    text = F.when(F.col("text") != "", entry("text", F.col("text"), F.lit(None)))
    call = F.when(end["tool_name"].isNotNull(), entry("call", F.lit(""), end["tool_use_id"]))
    rows = turns.select("session_id", F.col("off").alias("unit"), F.explode(F.array(text, call)).alias("t"))
    return rows.where("t is not null").select("session_id", "unit", "t.*")
