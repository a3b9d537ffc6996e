"""Dialect C tables and dialect D lines built by Spark from ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.fixture_a import EPOCH_2026, stamp
from workload.tables import spread, stored, table

CHUNK_WIDTH = 5


def _obj(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


@stored
def c_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 20 sessions; some hang below a session that is gone."""
    conv = F.col("conv_id")
    ids = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    created = (F.lit(EPOCH_2026) + conv * 3600) * 1000
    model = F.when(conv % 3 == 0, F.lit('{"providerID":"openai","modelID":"gpt-5.4","variant":"default"}')).when(
        conv % 3 == 1, F.lit('{"providerID":"openai","id":"gpt-5.5","variant":"high"}')
    )
    return ids.select(
        F.concat(F.lit("o"), conv.cast("string")).alias("id"),
        F.when(conv % 20 != 0, F.concat(F.lit("o"), (conv - 1).cast("string"))).when(conv % 100 == 20, F.concat(F.lit("gone-"), conv.cast("string"))).alias("parent_id"),
        F.concat(F.lit("/work/p"), (conv % 17).cast("string")).alias("directory"),
        F.when(conv % 4 != 0, F.concat(F.lit(" T"), conv.cast("string"))).alias("title"),
        model.alias("model"),
        created.alias("time_created"),
        (created + F.col("turns") * 60_000).alias("time_updated"),
    )


def _time() -> Column:
    return (F.lit(EPOCH_2026) + F.col("conv_id") * 3600) * 1000 + F.floor(F.col("turn") / 2) * 60_000


@stored
def c_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    rows = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return rows.select(
        F.concat_ws("-", F.lit("m"), conv.cast("string"), turn.cast("string")).alias("id"),
        F.concat(F.lit("o"), conv.cast("string")).alias("session_id"),
        F.to_json(_obj(role=F.col("role"), modelID=F.when(F.col("role") == "assistant", "gpt-5.4-mini"))).alias("data"),
        _time().alias("time_created"),
    )


@stored
def c_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    n = F.length(text)
    is_a = F.col("role") == "assistant"
    tag = F.concat_ws("-", conv.cast("string"), turn.cast("string"))
    call = F.concat(F.lit("call-"), tag)
    kind = turn % 8
    status = F.when(conv % 4 == 3, "running").when(conv % 4 == 2, "error").otherwise("completed")

    def tool(name: str, **st: Column) -> Column:
        return F.to_json(_obj(type=F.lit("tool"), tool=F.lit(name), callID=call, state=_obj(status=status, **st)))

    wrapped = F.concat(F.lit("<path>x</path><content>\n"), text, F.lit("\n</content>"))
    child = F.concat(F.lit("o"), (conv + 1).cast("string"))
    cases = [
        (0, F.lit(True), F.to_json(_obj(type=F.lit("text"), text=text))),
        (1, is_a & (n % 3 == 0), F.to_json(_obj(type=F.lit("reasoning"), text=F.left(text, F.lit(30))))),
        (2, is_a & (kind == 1), tool("read", input=_obj(filePath=F.lit("/a/b.py")), output=wrapped)),
        (2, is_a & (kind == 3), tool("bash", input=_obj(command=F.left(text, F.lit(12))), output=text)),
        (2, is_a & (kind == 5), tool("write", input=_obj(filePath=F.lit("/a/c.py"), content=F.left(text, F.lit(8))), output=F.lit("Wrote file"))),
        (2, is_a & (kind == 7), tool("edit", input=_obj(filePath=F.lit("/a/d.py")), output=F.lit("ok"), metadata=_obj(diff=F.lit("+x")))),
        (2, is_a & (kind == 2), tool(
            "question", input=_obj(questions=F.array(_obj(question=F.lit("Go on?")), _obj(question=F.lit("Why?")))),
            output=F.lit("answered"), metadata=_obj(answers=F.array(F.array(F.lit("Yes")))))),
        (3, is_a & turn.isin(1, 2), tool(
            "task", input=_obj(subagent_type=F.lit("explore")), output=F.lit("done"),
            metadata=_obj(sessionId=child, agent=F.when(conv % 3 == 0, "planner")))),
        (4, is_a, F.to_json(_obj(type=F.lit("step-finish"), tokens=_obj(
            input=n, output=turn, reasoning=n % 5, cache=_obj(read=n % 7, write=n % 3))))),
        (5, is_a & (turn % 6 == 4), F.to_json(_obj(type=F.lit("patch"), hash=F.concat(F.lit("h"), tag), files=F.array(F.lit("a"), F.lit("b"))))),
        (6, F.col("role") == "system", F.to_json(_obj(type=F.lit("compaction")))),
        (7, (turn == 0) & (conv % 7 == 0), F.lit('{"type":')),
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.when(cond, body).alias("data")) for k, cond, body in cases])
    return (
        spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
        .select("*", F.explode(F.filter(entries, lambda x: x["data"].isNotNull())).alias("x"))
        .select(
            F.concat(F.lit("p-"), tag, F.lit("-"), F.col("x.k").cast("string")).alias("id"),
            F.concat(F.lit("m-"), tag).alias("message_id"),
            F.concat(F.lit("o"), conv.cast("string")).alias("session_id"),
            F.col("x.data").alias("data"),
            _time().alias("time_created"),
        )
    )


@stored
def d_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, a level and a model change, then turns; every ninth file has no header."""
    conv, turn, text, role = (F.col(c) for c in ("conv_id", "turn", "text", "role"))
    n = F.length(text)
    sid = F.concat(F.lit("pi"), conv.cast("string"))
    at = stamp(conv, turn)
    ms = (F.lit(EPOCH_2026) + conv * 3600 + turn * 60) * 1000
    eid = F.concat_ws("-", F.lit("e"), conv.cast("string"), turn.cast("string"))

    def entry(kind: str, **fields: Column) -> Column:
        return F.to_json(_obj(type=F.lit(kind), **fields))

    is_a = role == "assistant"
    first = turn == 0
    blocks = F.array(
        F.struct(F.lit("thinking").alias("type"), F.lit(None).cast("string").alias("text"), F.left(text, F.lit(30)).alias("thinking"),
                 F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("arguments")),
        F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("thinking"),
                 F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("struct<command:string>").alias("arguments")),
        F.struct(F.lit("toolCall").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("thinking"),
                 F.concat(F.lit("t-"), eid).alias("id"), F.lit("bash").alias("name"), F.struct(F.left(text, F.lit(12)).alias("command")).alias("arguments")),
    )
    kept = F.filter(blocks, lambda b: ~((b["type"] == "toolCall") & (turn % 4 != 3)))
    usage = F.struct(n.alias("input"), turn.alias("output"), (n % 7).alias("cacheRead"), (n % 3).alias("cacheWrite"),
                     F.when(conv % 2 == 0, n + turn).alias("totalTokens"))
    cases = [
        (0, first & (conv % 9 != 8), entry("session", id=sid, timestamp=at, cwd=F.concat(F.lit("/work/p"), (conv % 17).cast("string")))),
        (1, first, entry("thinking_level_change", id=F.lit("x1"), thinkingLevel=F.lit("low"))),
        (2, first, entry("model_change", id=F.lit("x2"), provider=F.lit("openai"), modelId=F.lit("gpt-5.4"))),
        (3, turn == 2, entry("thinking_level_change", id=F.lit("x3"), thinkingLevel=F.lit("high"))),
        (4, role == "user", entry("message", id=eid, message=_obj(role=F.lit("user"), timestamp=ms, content=text))),
        (4, is_a, entry("message", id=eid, timestamp=at, message=_obj(
            role=F.lit("assistant"), provider=F.lit("openai"), model=F.concat(F.lit("gpt-5."), (F.lit(4) + turn % 2).cast("string")), content=kept, usage=usage))),
        (5, is_a & (turn % 4 == 3), entry("message", id=F.concat(eid, F.lit("r")), timestamp=at, message=_obj(
            role=F.lit("toolResult"), toolName=F.lit("bash"), toolCallId=F.concat(F.lit("t-"), eid), isError=conv % 5 == 0,
            content=F.array(_obj(type=F.lit("text"), text=text)), usage=_obj(input=n)))),
        (6, is_a & (turn % 4 == 1), entry("message", id=F.concat(eid, F.lit("b")), timestamp=at, message=_obj(
            role=F.lit("bashExecution"), command=F.lit("ls"), output=F.left(text, F.lit(9)), exitCode=conv % 3))),
        (7, role == "system", entry("compaction", id=F.concat(eid, F.lit("c")), timestamp=at, summary=text, usage=_obj(input=F.lit(5), output=F.lit(2)))),
        (8, (turn == 1) & (conv % 4 == 0), entry("session_info", name=F.concat(F.lit(" Name "), sid))),
        (9, (turn == 1) & (conv % 4 == 1), entry("custom_message", display=F.lit(False), content=F.lit("hidden"))),
    ]
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.when(cond, body).alias("line")) for k, cond, body in cases])
    off = turn * 10 + F.col("x.k")
    return (
        spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
        .select("*", F.explode(F.filter(entries, lambda x: x["line"].isNotNull())).alias("x"))
        .select(sid.alias("session_id"), F.floor(off / CHUNK_WIDTH).cast("bigint").alias("chunk"), off.cast("bigint").alias("off"), F.col("x.line").alias("line"))
    )
