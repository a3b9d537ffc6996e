"""Dialect A lines built by Spark from ``conversations`` (message / content-block transcripts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.tables import spread, stored, table

CHUNK_WIDTH = 40
EPOCH_2026 = 1_767_225_600


def stamp(conv: Column, turn: Column) -> Column:
    seconds = F.lit(EPOCH_2026) + conv * 3600 + turn * 60
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


@stored
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, text, role = (F.col(c) for c in ("conv_id", "turn", "text", "role"))
    n = F.length(text)
    sid = F.concat(F.lit("c"), conv.cast("string"))
    at = stamp(conv, turn)
    call = F.concat_ws("-", F.lit("call"), conv.cast("string"), turn.cast("string"))
    second_call = F.concat(call, F.lit("-b"))
    mid = F.concat_ws("-", F.lit("m"), conv.cast("string"), turn.cast("string"))
    model = F.concat(F.lit("claude-opus-4-"), (F.lit(6) + conv % 2).cast("string"))
    noisy = (conv % 6 == 2) & (turn < 2)
    prompt = F.when(noisy, F.concat(F.lit("<local-command>"), text)).otherwise(text)

    def block(**fields: Column) -> Column:
        return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))

    def text_block(body: Column) -> Column:
        return block(type=F.lit("text"), text=body)

    def raw_array(*blocks: Column) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *blocks), F.lit("]"))

    usage = F.to_json(
        F.struct(
            n.alias("input_tokens"),
            turn.alias("output_tokens"),
            (n % 7).alias("cache_read_input_tokens"),
            (n % 3).alias("cache_creation_input_tokens"),
        )
    )

    def assistant(content: Column, stop: Column | None, with_usage: bool) -> Column:
        parts = [
            F.lit('{"type":"assistant","timestamp":"'),
            at,
            F.lit('","message":{"role":"assistant","id":"'),
            mid,
            F.lit('","model":"'),
            model,
            F.lit('","stop_reason":'),
            F.lit("null") if stop is None else F.concat(F.lit('"'), stop, F.lit('"')),
        ]
        if with_usage:
            parts += [F.lit(',"usage":'), usage]
        return F.concat(*parts, F.lit(',"content":'), content, F.lit("}}"))

    thinking = F.when(n % 3 == 0, block(type=F.lit("thinking"), thinking=F.left(text, F.lit(30))))
    tool_use = block(
        type=F.lit("tool_use"), id=call, name=F.lit("Bash"), input=F.struct(F.left(text, F.lit(20)).alias("command"))
    )
    tool_use_b = block(
        type=F.lit("tool_use"),
        id=second_call,
        name=F.lit("Read"),
        input=F.struct(F.concat(F.lit("/work/src/f"), (n % 5).cast("string"), F.lit(".py")).alias("file_path")),
    )
    result = F.concat(
        F.lit('{"type":"user","timestamp":"'),
        at,
        F.lit('","message":{"role":"user","content":'),
        raw_array(block(type=F.lit("tool_result"), tool_use_id=call, content=text)),
        F.lit('},"toolUseResult":'),
        block(stdout=text, stderr=F.lit(""), interrupted=F.lit(False)),
        F.lit("}"),
    )
    hook = F.concat(
        F.lit('{"type":"attachment","timestamp":"'),
        at,
        F.lit('","attachment":'),
        block(
            type=F.lit("hook_success"),
            hookEvent=F.lit("PreToolUse"),
            hookName=F.lit("PreToolUse:Bash"),
            toolUseID=call,
            stdout=F.lit(""),
        ),
        F.lit("}"),
    )
    user = F.concat(
        F.lit('{"type":"user","cwd":"/work/p'),
        (conv % 17).cast("string"),
        F.lit('","timestamp":"'),
        at,
        F.lit('","message":{"role":"user","content":'),
        F.when(conv % 2 == 1, raw_array(text_block(text))).otherwise(
            F.expr("to_json(named_struct('t', prompt))").substr(F.lit(6), F.length(F.expr("to_json(named_struct('t', prompt))")) - 6)
        ),
        F.lit("}}"),
    )
    system = F.to_json(
        F.struct(
            F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), text.alias("content"), at.alias("timestamp")
        )
    )
    is_a = role == "assistant"
    plain = is_a & (turn % 2 == 0)
    chunked = is_a & (turn % 4 == 1)
    tool = is_a & (turn % 4 == 3)
    cases = [
        (0, role == "user", user),
        (0, role == "system", system),
        (0, plain, assistant(raw_array(thinking, text_block(text)), F.lit("end_turn"), True)),
        (0, chunked, assistant(raw_array(text_block(F.left(text, F.lit(10)))), None, False)),
        (1, chunked, assistant(raw_array(text_block(F.substring(text, 11, 2_000_000_000))), F.lit("end_turn"), True)),
        (0, tool, assistant(raw_array(text_block(text)), None, False)),
        (1, tool, assistant(raw_array(tool_use), F.lit("tool_use"), True)),
        (2, tool & (conv % 3 == 0), assistant(raw_array(tool_use_b), F.lit("tool_use"), False)),
        (3, tool & (conv % 5 != 0), result),
        (4, tool, hook),
        (5, tool, hook),
        (7, (turn == 0) & (conv % 7).isin(0, 3), F.concat(F.lit('{"type":"summary","summary":" Sum '), sid, F.lit('"}'))),
        (8, (turn == 0) & (conv % 7 == 0), F.lit('{"type":')),
        (9, (turn == 0) & (conv % 7 == 0), F.concat(F.lit('{"type":"custom-title","customTitle":"Title '), sid, F.lit('"}'))),
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.when(cond, line).alias("line")) for k, cond, line in cases])
    off = turn * 10 + F.col("e.k")
    return (
        spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
        .withColumn("prompt", prompt)
        .withColumn("e", F.explode(F.filter(entries, lambda e: e["line"].isNotNull())))
        .select(
            sid.alias("session_id"),
            F.floor(off / CHUNK_WIDTH).cast("bigint").alias("chunk"),
            off.cast("bigint").alias("off"),
            F.col("e.line").alias("line"),
        )
    )
