"""Dialect B rollouts built by Spark from ``events``: a forest of threads with cumulative counters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.tables import spread, stored, table

CHUNK_WIDTH = 4


Part = str | Column | tuple


def _constant(text: str) -> str:
    """What stands between the quotes of a JSON string."""
    return json.dumps(text, ensure_ascii=False)[1:-1]


def _joined(*parts: Part) -> Column:
    """Constants, columns, and (condition, parts) of fields that some lines lack, as one text; neighbouring constants are put together."""
    out: list[str | Column] = []
    for part in parts:
        if isinstance(part, tuple):
            part = F.when(part[0], _joined(*part[1:])).otherwise("")
        if isinstance(part, str) and out and isinstance(out[-1], str):
            out[-1] += part
        else:
            out.append(part)
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in out])


@stored
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are put together from constants, ids and numbers, which need no escapes; writing thirteen of them a thread as JSON objects took most of the time."""
    e, es, at, c = (F.col(x) for x in ("event_id", "es", "at", "c"))
    sub = e % 3 != 0
    path = ("/root/task", es)
    parent = F.when(e % 97 == 5, F.concat(F.lit("missing-"), es)).otherwise(F.floor(e / 3).cast("bigint").cast("string"))
    hint = (
        F.when(sub & (e % 29 == 1), ((e % 7) * 3).cast("string"))
        .when(sub & (e % 31 == 2), F.lit("1"))
        .when(~sub, es)
    )

    def line(kind: str, *payload: Part) -> Column:
        return _joined('{"timestamp":"', at, f'","type":"{kind}","payload":{{', *payload, "}}")

    def counter(i: Column, o: Column, h: Column, t: Column) -> Column:
        usage = F.to_json(F.struct(i.alias("input_tokens"), o.alias("output_tokens"), h.alias("cached_input_tokens"), t.alias("total_tokens")))
        return line("event_msg", '"type":"token_count","info":{"total_token_usage":', usage, "}")

    def message(role: str, *text: Part) -> Column:
        return line("response_item", f'"type":"message","role":"{role}","content":[{{"type":"input_text","text":"', *text, '"}]')

    def call(name: str, cid: tuple, *args: Part) -> Column:
        return line("response_item", f'"type":"function_call","name":"{name}","call_id":"', *cid, '","arguments":"', *[_constant(a) if isinstance(a, str) else a for a in args], '"')

    def output(cid: tuple, *text: Part) -> Column:
        return line("response_item", '"type":"function_call_output","call_id":"', *cid, '","output":"', *[_constant(x) if isinstance(x, str) else x for x in text], '"')

    first, second = ("sp-", es, "-1"), ("sp-", es, "-2")
    shell, ask = ("sh-", es), ("ask-", es)
    child1, child2 = (e * 3 + 1).cast("string"), (e * 3 + 2).cast("string")
    status = ("Exit code: ", (e % 4).cast("string"), "\nWall time: ", F.floor((e % 30) / 10).cast("string"), ".", (e % 10).cast("string"), " seconds\nOutput:\nline ", es)
    total = F.when(e % 23 == 4, F.lit(1).cast("bigint")).otherwise(c + c % 11 + 135)
    questions = ('{"questions":[{"id":"q1","question":"Which ', es, '?"},{"id":"q2","question":"Why?"},{"id":"q3","question":"When?"}]}')
    cases = [
        (0, F.lit(True), line(
            "session_meta", '"id":"', es, '"', (hint.isNotNull(), ',"session_id":"', hint, '"'), (sub, ',"parent_thread_id":"', parent, '"'), ',"cwd":"/work/p', (e % 17).cast("string"),
            '","model_provider":"openai","cli_version":"1.0"', (sub, ',"agent_path":"', *path, '","thread_source":"subagent"'))),
        (1, F.lit(True), line("turn_context", '"model":"gpt-5.', (F.lit(4) + e % 2).cast("string"), '","effort":"high","sandbox_policy":{"type":"read-only"}')),
        (2, sub & (e % 7 == 0), line("session_meta", '"id":"inherited"')),
        (3, F.lit(True), counter(c, c % 11, c % 7, c + c % 11)),
        (4, sub, line("response_item", '"type":"agent_message","recipient":"', F.when(e % 4 == 1, "other").otherwise(F.concat(F.lit(path[0]), es)), '"')),
        (5, F.lit(True), message("user", F.when(e % 6 == 0, " <env>").otherwise("Prompt "), es)),
        (10, F.lit(True), call("spawn_agent", first, '{"task_name":"x', es, '"}')),
        (11, e % 2 == 0, line("event_msg", '"type":"sub_agent_activity","kind":"started","agent_thread_id":"', child1, '","event_id":"', *first, '"')),
        (11, e % 2 == 1, output(first, '{"agent_id":"', child1, '"}')),
        (12, e % 4 != 3, call("spawn_agent", second, '{"task_name":"task', child2, '"}')),
        (13, F.lit(True), call("shell_command", shell, '{"command":"ls ', es, '"}')),
        (14, F.lit(True), output(shell, *status)),
        (15, F.lit(True), counter(c + 100 + e % 13, c % 11 + 5, c % 7 + 1, total)),
        (16, F.lit(True), line("event_msg", '"type":"agent_reasoning","text":"Think ', es, '"')),
        (17, F.lit(True), message("assistant", "Answer ", es)),
        (18, e % 9 == 0, call("request_user_input", ask, *questions)),
        (19, e % 9 == 0, output(ask, '{"answers":{"q1":{"answers":["A","B"]},"q2":["C"]}}')),
    ]
    entries = F.array(*[F.struct(F.lit(k).cast("bigint").alias("off"), F.when(cond, text).alias("line")) for k, cond, text in cases])
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + e * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        spread(table(spark, sf_dir, "events").select("event_id", "value"), "event_id")
        .select("event_id", e.cast("string").alias("es"), stamp.alias("at"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
        .select("es", F.explode(F.filter(entries, lambda x: x["line"].isNotNull())).alias("x"))
        .select(
            F.concat(F.lit("rollout-"), es).alias("session_id"),
            F.floor(F.col("x.off") / CHUNK_WIDTH).cast("bigint").alias("chunk"),
            F.col("x.off").alias("off"),
            F.col("x.line").alias("line"),
        )
    )


def thread_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side table with titles (some unreadable) and epoch times in seconds or milliseconds."""
    e = F.col("event_id")
    es = e.cast("string")
    title = (
        F.when(e % 5 == 0, F.lit("  "))
        .when(e % 5 == 1, F.concat(F.lit("????"), es))
        .when(e % 5 == 2, F.concat(F.lit(" Title "), es))
        .when(e % 5 == 3, F.concat(F.lit("bad � "), es))
    )
    seconds = F.lit(1_767_225_600) + e
    return table(spark, sf_dir, "events").where(e % 2 == 0).select(
        es.alias("thread_id"),
        title.alias("title"),
        F.when(e % 4 == 0, seconds).otherwise(seconds * 1000).alias("created_at"),
        F.when(e % 3 != 0, seconds * 1000 + 60_000).alias("updated_at"),
    )


def memory_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    es = e.cast("string")
    return table(spark, sf_dir, "events").where(e % 3 == 0).select(
        es.alias("thread_id"),
        F.concat(F.lit("---\n<skip>\n## - Memory "), es, F.lit("\nmore")).alias("raw_memory"),
        F.when(e % 2 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("\n# Summary "), es, F.lit(" é"))).alias("rollout_summary"),
        F.when(e % 5 != 0, e % 7).alias("usage_count"),
        F.when(e % 4 != 0, e * 10).alias("last_usage"),
        (e * 10 + 5).alias("generated_at"),
    )
