"""Streaming jobs, each drained over the given tables and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators.ordered import RunningSum, ordered_scan, with_chunk
from skeinlog.session import scratch_path
from skeinlog.streaming import activity, ingest, sinks, turns
from workload import fixture_a
from workload.area_a import BASE as A_BASE
from workload.registry import Area
from workload.tables import table

area = Area()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of sessions' turns."""
    schema = table(spark, sf_dir, "events").schema
    # a glob, because the stream source takes a plain path for a folder and the table may be one file
    rows = ingest.read_deltas(spark, f"{sf_dir}/events.parque[t]", schema)
    c = F.round(F.col("value") * 100).cast("bigint")
    return rows.select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get(F.array(F.lit("claude"), F.lit("codex"), F.lit("opencode"), F.lit("pi")), (F.col("user_id") % 4).cast("int")).alias("source"),
        c.alias("input_tokens"),
        c.alias("total_tokens"),
    )


def _logged(spark: SparkSession, stream: DataFrame, mode: str, label: str) -> DataFrame:
    """Drain a stream into an upsert log and read the log."""
    path = scratch_path(spark, label)
    sinks.drain(stream.writeStream.outputMode(mode).foreachBatch(sinks.append_log(f"{path}/log")), f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/log")


@area.query(
    "stream_daily_usage",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, ['claude', 'codex', 'opencode', 'pi'][user_id % 4 + 1] AS source, count(*) AS turns,
    sum(CAST(ROUND(value*100) AS BIGINT))::BIGINT AS input_tokens, sum(CAST(ROUND(value*100) AS BIGINT))::BIGINT AS total_tokens FROM events GROUP BY 1, 2""",
)
def stream_daily_usage(spark, sf_dir):
    log = _logged(spark, activity.daily_usage(event_stream(spark, sf_dir)), "update", "daily")
    return sinks.latest(log, ["day", "source"]).select("day", "source", "turns", "input_tokens", "total_tokens")


@area.query(
    "stream_sliding_activity",
    """SELECT strftime(d, '%Y-%m-%d') AS from_day, strftime(d + INTERVAL 7 DAY, '%Y-%m-%d') AS to_day, count(*) AS events
    FROM (SELECT unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM events) GROUP BY d""",
)
def stream_sliding_activity(spark, sf_dir):
    log = _logged(spark, activity.sliding_activity(event_stream(spark, sf_dir)), "update", "sliding")
    return sinks.latest(log, ["from_day", "to_day"]).select("from_day", "to_day", "events")


@area.query(
    "stream_settled_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS isl FROM g),
    x AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS changes FROM i GROUP BY user_id, isl)
    SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS first_change, strftime(b, '%Y-%m-%d %H:%M:%S') AS quiet_at, changes FROM x WHERE b <= (SELECT max(ts) FROM events)""",
)
def stream_settled_sessions(spark, sf_dir):
    """Only bursts that have gone quiet before the newest event are emitted."""
    log = _logged(spark, activity.settled(event_stream(spark, sf_dir), "user_id", "6 hours"), "append", "settled")
    fmt = "yyyy-MM-dd HH:mm:ss"
    return log.select("user_id", F.date_format("first_change", fmt).alias("first_change"), F.date_format("quiet_at", fmt).alias("quiet_at"), "changes")


@area.query(
    "stream_latest_counters",
    """WITH c AS (SELECT user_id, event_id, sum(CAST(ROUND(value*100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS cum FROM events)
    SELECT user_id, max(event_id) AS event_id, arg_max(cum, event_id)::BIGINT AS usage FROM c GROUP BY 1""",
)
def stream_latest_counters(spark, sf_dir):
    """Cumulative counters delivered in two runs, the newer half first; the checkpoint carries the state over."""
    path = scratch_path(spark, "counters")
    events = table(spark, sf_dir, "events").withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    cum = ordered_scan(with_chunk(events, "event_id", 1000), ["user_id"], ["event_id"], [RunningSum("usage", F.col("c"))]).select("user_id", "event_id", "usage")
    for run, part in enumerate((cum.where("event_id % 2 = 1"), cum.where("event_id % 2 = 0"))):
        part.write.mode("append").parquet(f"{path}/in")
        stream = ingest.read_deltas(spark, f"{path}/in", cum.schema)
        counters = activity.latest_counters(stream, ["user_id"], "event_id")
        sinks.drain(counters.writeStream.outputMode("update").foreachBatch(sinks.append_log(f"{path}/log")), f"{path}/checkpoint")
    return sinks.latest(spark.read.parquet(f"{path}/log"), ["user_id"]).select("user_id", "event_id", "usage")


@area.query(
    "stream_counters_without_state",
    """WITH c AS (SELECT user_id, event_id, sum(CAST(ROUND(value*100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS cum FROM events)
    SELECT user_id, max(event_id) AS event_id, arg_max(cum, event_id)::BIGINT AS usage FROM c GROUP BY 1""",
)
def stream_counters_without_state(spark, sf_dir):
    """The same counters from a log of batches, the newer half first."""
    path = scratch_path(spark, "counters")
    events = table(spark, sf_dir, "events").withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    cum = ordered_scan(with_chunk(events, "event_id", 1000), ["user_id"], ["event_id"], [RunningSum("usage", F.col("c"))]).select("user_id", "event_id", "usage")
    for part in (cum.where("event_id % 2 = 1"), cum.where("event_id % 2 = 0")):
        part.write.mode("append").parquet(f"{path}/in")
        stream = ingest.read_deltas(spark, f"{path}/in", cum.schema)
        sinks.drain(stream.writeStream.foreachBatch(activity.counters_into(f"{path}/log", ["user_id"], "event_id")), f"{path}/checkpoint")
    return sinks.latest(spark.read.parquet(f"{path}/log"), ["user_id"], ["event_id"]).select("user_id", "event_id", "usage")


@area.query(
    "stream_turns_of_quiet_sessions",
    A_BASE
    + """, t AS (SELECT session_id, conv_id, turn*10 + CASE WHEN plain THEN 0 ELSE 1 END AS unit, text, chunked OR tool AS two FROM b WHERE role = 'assistant')
    SELECT session_id, unit, text AS content FROM t WHERE NOT (two AND unit = 31)
    UNION ALL SELECT session_id, 30, text FROM b WHERE turn = 3 AND tool""",
)
def stream_turns_of_quiet_sessions(spark, sf_dir):
    """The stream stops in the middle of messages and goes on with other sessions; texts that stay open are given out, later lines stand for themselves."""
    path = scratch_path(spark, "turns")
    lines = fixture_a.lines(spark, sf_dir)
    # two quiet intervals after the newest line, whatever the number of conversations; an empty table has no later session
    newest = table(spark, sf_dir, "conversations").agg(F.max(fixture_a.stamp(F.col("conv_id"), F.col("turn"))).alias("ts")).where("ts is not null")
    last = F.date_format(F.to_timestamp("ts") + F.expr("interval 60 days"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    later = newest.select(
        F.lit("later").alias("session_id"), F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("off"),
        F.concat(F.lit('{"type":"assistant","timestamp":"'), last, F.lit('","message":{"role":"assistant","stop_reason":"end_turn","content":[]}}')).alias("line"),
    )
    for part in (lines.where("off <= 30"), later, lines.where("off > 30")):
        part.write.mode("append").parquet(f"{path}/in")
        stream = ingest.read_deltas(spark, f"{path}/in", lines.schema)
        sinks.drain(stream.writeStream.foreachBatch(turns.merge_into(f"{path}/turns", "30 days")), f"{path}/checkpoint")
    return turns.closed_turns(spark, f"{path}/turns").where("kind = 'text'").select("session_id", "unit", "content")


@area.query("stream_deduplicated_lines", "SELECT user_id, count(*) AS lines, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1")
def stream_deduplicated_lines(spark, sf_dir):
    """Every hundredth line is delivered again in a second run and must not count twice."""
    path = scratch_path(spark, "dedup")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), F.col("event_id").alias("off"), "user_id", F.col("ts").cast("timestamp").alias("ts")
    )
    for part in (rows, rows.where("off % 100 = 0")):
        part.write.mode("append").parquet(f"{path}/in")
        once = ingest.deduplicated(ingest.read_deltas(spark, f"{path}/in", rows.schema), "ts", "60 days")
        sinks.drain(once.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{path}/out").groupBy("user_id").agg(F.count("*").alias("lines"), F.sum("off").alias("id_sum"))


@area.query(
    "stream_merged_turns",
    A_BASE
    + """SELECT session_id, turn*10 + CASE WHEN plain THEN 0 ELSE 1 END AS unit, 'text' AS kind, text AS content, NULL AS tool_use_id FROM b WHERE role = 'assistant'
    UNION ALL SELECT session_id, turn*10+1, 'call', '', call_id FROM b WHERE tool
    UNION ALL SELECT session_id, turn*10+2, 'call', '', call_id || '-b' FROM b WHERE tool AND conv_id % 3 = 0""",
)
def stream_merged_turns(spark, sf_dir):
    """The lines are cut in the middle of a message; the open text is carried into the next run."""
    path = scratch_path(spark, "turns")
    lines = fixture_a.lines(spark, sf_dir)
    for part in (lines.where("off <= 30"), lines.where("off > 30")):
        part.write.mode("append").parquet(f"{path}/in")
        stream = ingest.read_deltas(spark, f"{path}/in", lines.schema)
        sinks.drain(stream.writeStream.foreachBatch(turns.merge_into(f"{path}/turns")), f"{path}/checkpoint")
    return turns.closed_turns(spark, f"{path}/turns")


@area.query(
    "stream_session_upsert",
    """SELECT doc_id AS key, CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS version, length(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS chars FROM documents""",
)
def stream_session_upsert(spark, sf_dir):
    """A changed older session replaces its row: versions arrive in two runs, the log is merged on read."""
    path = scratch_path(spark, "upsert")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit(1).alias("version"), F.length("text").alias("chars"))
    changed = rows.where("key % 7 = 0").withColumns({"version": F.lit(2), "chars": F.col("chars") + 1})
    for part in (rows, changed):
        part.write.mode("append").parquet(f"{path}/in")
        stream = ingest.read_deltas(spark, f"{path}/in", rows.schema)
        sinks.drain(stream.writeStream.foreachBatch(sinks.append_log(f"{path}/log")), f"{path}/checkpoint")
    return sinks.latest(spark.read.parquet(f"{path}/log"), ["key"], ["version"]).select("key", "version", "chars")


@area.query(
    "stream_text_ingest",
    "SELECT doc_id // 50 AS shard, count(*) AS lines, sum(strlen(t))::BIGINT AS bytes FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY 1",
)
def stream_text_ingest(spark, sf_dir):
    """Line files picked up by the text stream and appended to the line table."""
    path = scratch_path(spark, "ingest")
    shard = F.floor(F.col("doc_id") / 50).cast("bigint")
    docs = table(spark, sf_dir, "documents").select(shard.alias("shard"), F.col("text").alias("value"))
    docs.repartition("shard").write.partitionBy("shard").text(f"{path}/in")
    stream = ingest.read_text(spark, f"{path}/in", 100)
    sinks.drain(stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    rows = spark.read.parquet(f"{path}/out")
    key = F.regexp_extract("file_path", r"shard=(\d+)/", 1).cast("bigint")
    return rows.groupBy(key.alias("shard")).agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).cast("bigint").alias("bytes"))
