"""Dialect D: a header line, then tree entries (``id`` / ``parentId``) whose branches all stay visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skeinlog.functions import strings, times
from skeinlog.functions import variants as V
from skeinlog.functions.text import snippet
from skeinlog.operators.ordered import LastValue, ordered_scan
from skeinlog.schemas import RECORD_COLUMNS, TEXT_COLUMNS, USAGE_COLUMNS
from skeinlog.sources.dialect_a import visible

SOURCE = "pi"


def parsed(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    v = F.col("v")
    base = V.with_parsed(lines, counts=counts)
    millis = F.coalesce(
        V.get(v, "$.message.timestamp", "bigint"), F.unix_millis(times.instant(V.text(v, "$.timestamp")))
    )
    return base.select(
        "*",
        F.coalesce(V.get(v, "$.type"), F.lit("")).alias("entry"),
        F.coalesce(V.get(v, "$.message.role"), F.lit("")).alias("role"),
        millis.alias("millis"),
        times.millis_text(millis).alias("ts"),
    )


def headers(lines: DataFrame) -> DataFrame:
    """First valid line of every file; only files that open with a session header are kept."""
    v = F.col("v")
    firsts = lines.withColumn("ok", V.parse("line").isNotNull()).where("ok")
    firsts = firsts.groupBy("session_id").agg(F.min_by("line", "off").alias("line"), F.min("off").alias("header_off"))
    rows = firsts.withColumn("v", V.parse("line")).where(V.get(v, "$.type") == "session")
    return rows.select(
        "session_id",
        "header_off",
        V.blank_to_null(V.text(v, "$.id")).alias("native_id"),
        F.coalesce(V.text(v, "$.cwd"), F.lit("")).alias("project_path"),
        times.local_text(V.blank_to_null(V.text(v, "$.timestamp"))).alias("created_at"),
    ).where("native_id is not null")


def content_text(v: Column, path: str) -> Column:
    """Block texts joined by newlines, images as placeholders."""

    def one(b: Column) -> Column:
        mime = V.get(b, "$.mimeType")
        image = F.when(mime.isNotNull(), F.concat(F.lit("[image: "), mime, F.lit("]"))).otherwise("[image]")
        kind = V.get(b, "$.type")
        return F.when(kind == "text", V.get(b, "$.text")).when(kind == "image", image)

    parts = F.filter(F.transform(V.array(v, path), one), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(parts, "\n"), V.text(v, path), F.lit(""))


def _not_hidden(v: Column, path: str) -> Column:
    return F.coalesce(V.get(v, path, "boolean"), F.lit(True))


def _blocks() -> Column:
    return F.transform(
        V.array(F.col("v"), "$.message.content"),
        lambda b: F.struct(
            F.coalesce(V.get(b, "$.type"), F.lit("")).alias("type"),
            F.coalesce(V.get(b, "$.text"), F.lit("")).alias("text"),
            F.coalesce(V.get(b, "$.thinking"), F.lit("")).alias("thinking"),
            V.blank_to_null(V.get(b, "$.name")).alias("name"),
            V.blank_to_null(V.get(b, "$.id")).alias("id"),
            V.as_json(V.sub(b, "$.arguments")).alias("arguments"),
        ),
    )


def records(lines: DataFrame, min_level: str = "debug") -> DataFrame:
    """Timeline records, one row per content block in block order, branches in file order; files without a header give none."""
    v, role = F.col("v"), F.col("role")
    rows = parsed(lines).join(headers(lines).select("session_id"), "session_id", "left_semi")

    def rec(record_type, level, content, **extra) -> Column:
        cols = {
            "record_type": F.lit(record_type),
            "level": F.lit(level),
            "content": F.lit(content) if isinstance(content, str) else content,
        }
        for n in ("tool_name", "tool_use_id", "tool_input", "result_meta"):
            cols[n] = extra.get(n, F.lit(None)).cast("string")
        return F.struct(*[c.alias(n) for n, c in cols.items()])

    block_records = F.transform(
        _blocks(),
        lambda b: F.when(b["type"] == "text", rec("assistant", "content", b["text"]))
        .when(b["type"] == "thinking", rec("thinking", "content", b["thinking"]))
        .when(
            b["type"] == "toolCall",
            rec("assistant", "tool", "", tool_name=b["name"], tool_use_id=b["id"], tool_input=b["arguments"]),
        ),
    )
    body = content_text(v, "$.message.content")
    is_error = V.get(v, "$.message.isError", "boolean")
    bash_id = F.concat(F.lit("pi-bash-"), F.coalesce(V.text(v, "$.id"), F.lit("bash")))
    bash_meta = F.to_json(
        F.struct(
            F.struct(
                V.sub(v, "$.message.exitCode").alias("exit_code"),
                F.coalesce(V.get(v, "$.message.cancelled", "boolean"), F.lit(False)).alias("cancelled"),
                F.coalesce(V.get(v, "$.message.truncated", "boolean"), F.lit(False)).alias("truncated"),
            ).alias("terminal")
        ),
        {"ignoreNullFields": "false"},
    )

    def said(path: str) -> Column:
        return F.coalesce(V.text(v, path), F.lit(""))

    command = F.to_json(F.struct(said("$.message.command").alias("command")))
    debug_message = F.array(rec("meta", "debug", F.coalesce(V.as_json(V.sub(v, "$.message")), F.lit(""))))
    of_message = (
        F.when(role == "user", F.array(rec("user", "content", body)))
        .when(role == "assistant", F.coalesce(block_records, F.slice(debug_message, 1, 0)))
        .when(
            role == "toolResult",
            F.array(
                rec(
                    "tool_result",
                    "tool",
                    body,
                    tool_name=V.blank_to_null(V.text(v, "$.message.toolName")),
                    tool_use_id=V.blank_to_null(V.text(v, "$.message.toolCallId")),
                    result_meta=F.when(is_error.isNotNull(), F.to_json(F.struct(is_error.alias("is_error")))),
                )
            ),
        )
        .when(
            role == "bashExecution",
            F.array(
                rec("assistant", "tool", "", tool_name=F.lit("bash"), tool_use_id=bash_id, tool_input=command),
                rec("tool_result", "tool", said("$.message.output"), tool_name=F.lit("bash"), tool_use_id=bash_id, result_meta=bash_meta),
            ),
        )
        .when((role == "custom") & _not_hidden(v, "$.message.display"), F.array(rec("meta", "content", body)))
        .when(role.isin("branchSummary", "compactionSummary"), F.array(rec("meta", "content", said("$.message.summary"))))
        .otherwise(debug_message)
    )
    entry = F.col("entry")
    preview = (
        F.when(entry == "session", F.concat(F.lit("session "), said("$.id"), F.lit(" · "), said("$.cwd")))
        .when(entry == "model_change", F.concat(F.lit("model: "), said("$.provider"), F.lit("/"), said("$.modelId")))
        .when(entry == "thinking_level_change", F.concat(F.lit("thinking level: "), said("$.thinkingLevel")))
        .when(entry == "session_info", F.concat(F.lit("session name: "), said("$.name")))
        .when(entry == "label", F.concat(F.lit("label: "), said("$.label")))
        .otherwise(V.as_json(v))
    )
    entries = (
        F.when(entry == "message", F.when(V.sub(v, "$.message").isNotNull(), of_message))
        .when(
            entry == "custom_message",
            F.when(_not_hidden(v, "$.display"), F.array(rec("meta", "content", content_text(v, "$.content")))),
        )
        .when(entry.isin("compaction", "branch_summary"), F.array(rec("meta", "content", said("$.summary"))))
        .otherwise(F.array(rec("meta", "debug", preview)))
    )
    return (
        rows.select(
            "session_id", "chunk", F.col("off").alias("unit"), "ts", V.blank_to_null(V.text(v, "$.id")).alias("group_id"), entries.alias("entries")
        )
        .select("session_id", "chunk", "unit", "ts", "group_id", F.posexplode(F.array_compact("entries")).alias("seq", "r"))
        .select("session_id", "chunk", "unit", "seq", "r.*", "ts", "group_id", F.lit(None).cast("string").alias("diff"))
        .where(visible(F.col("level"), min_level))
        .select(*RECORD_COLUMNS)
    )


def _usage(v: Column, base: str) -> Column:
    inp, out = V.number(v, f"{base}.input"), V.number(v, f"{base}.output")
    cache = V.number(v, f"{base}.cacheRead") + V.number(v, f"{base}.cacheWrite")
    total = F.coalesce(V.get(v, f"{base}.totalTokens", "bigint"), inp + out + cache)
    return F.struct(*[c.alias(n) for n, c in zip(USAGE_COLUMNS, (inp, out, cache, total), strict=True)])


def sessions(lines: DataFrame) -> DataFrame:
    """One row per session: last name, first prompt, last activity and usage.

    Tool-result usage is not counted: it belongs to the tool, not to the model turn.
    """
    v, entry, role, off = F.col("v"), F.col("entry"), F.col("role"), F.col("off")
    said = entry == "message"
    use = F.when(said & (role == "assistant"), _usage(v, "$.message.usage")).when(
        entry.isin("compaction", "branch_summary"), _usage(v, "$.usage")
    )
    text = content_text(v, "$.message.content")
    prompt = F.when(said & (role == "user") & (strings.trim(text) != ""), text)
    active = F.when(said & role.isin("user", "assistant"), F.col("millis"))
    renamed = entry == "session_info"
    rows = parsed(lines).select(
        "session_id",
        "off",
        use.alias("use"),
        prompt.alias("prompt"),
        active.alias("active"),
        F.when(renamed, F.struct(V.blank_to_null(V.text(v, "$.name")).alias("name"))).alias("renamed"),
    )
    folded = rows.groupBy("session_id").agg(
        F.max_by("renamed", F.when(F.col("renamed").isNotNull(), off)).alias("r"),
        F.min_by("prompt", F.when(F.col("prompt").isNotNull(), off)).alias("first_prompt"),
        F.max("active").alias("active"),
        *[F.coalesce(F.sum(f"use.{c}"), F.lit(0)).cast("bigint").alias(c) for c in USAGE_COLUMNS],
    )
    return headers(lines).join(folded, "session_id").select(
        "session_id",
        "native_id",
        "project_path",
        "created_at",
        F.coalesce(times.millis_text(F.col("active")), F.col("created_at")).alias("updated_at"),
        "first_prompt",
        F.col("r.name").alias("agent_title"),
        *USAGE_COLUMNS,
    )


def model_turns(lines: DataFrame) -> DataFrame:
    """Model contexts of a session: provider, model and thinking level are carried forward over entries."""
    v, entry = F.col("v"), F.col("entry")
    switches = entry == "model_change"
    answers = (entry == "message") & (F.col("role") == "assistant")
    levels = entry == "thinking_level_change"
    gate = F.col("line").contains("model_change") | F.col("line").contains("thinking_level_change") | F.col("line").contains('"assistant"')
    rows = parsed(lines.where(gate)).where(switches | answers | levels)

    def field(path: str) -> Column:
        return V.blank_to_null(V.text(v, path))

    named = F.when(switches, F.struct(field("$.provider").alias("provider"), field("$.modelId").alias("model"))).when(
        answers, F.struct(field("$.message.provider").alias("provider"), field("$.message.model").alias("model"))
    )
    level = F.when(levels, F.struct(field("$.thinkingLevel").alias("level")))
    rows = rows.select("session_id", "chunk", "off", levels.alias("is_level"), named.alias("named"), level.alias("level_set"))
    carried = ordered_scan(
        rows, ["session_id"], ["off"], [LastValue("cur", F.col("named")), LastValue("lev", F.col("level_set"))]
    )
    known = F.col("cur.provider").isNotNull() | F.col("cur.model").isNotNull()
    return carried.where(~F.col("is_level") | known).select(
        "session_id", "off", F.col("cur.provider").alias("provider"), F.col("cur.model").alias("model"), F.col("lev.level").alias("thinking_level")
    )


def texts(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    v, entry, role = F.col("v"), F.col("entry"), F.col("role")
    body = content_text(v, "$.message.content")

    def e(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def said(path: str) -> Column:
        return F.coalesce(V.text(v, path), F.lit(""))

    of_blocks = F.transform(
        _blocks(),
        lambda b: F.when(b["type"] == "text", e("content", b["text"]))
        .when(b["type"] == "thinking", e("reasoning", b["thinking"]))
        .when(
            b["type"] == "toolCall",
            e("tool", F.concat(F.coalesce(b["name"], F.lit("")), F.lit(" "), F.coalesce(b["arguments"], F.lit("")))),
        ),
    )
    of_message = (
        F.when(role == "user", F.array(e("content", body)))
        .when(role == "assistant", of_blocks)
        .when(role == "toolResult", F.array(e("tool", F.concat(said("$.message.toolName"), F.lit(" "), body))))
        .when(role == "bashExecution", F.array(e("tool", said("$.message.command")), e("tool", said("$.message.output"))))
        .when((role == "custom") & _not_hidden(v, "$.message.display"), F.array(e("content", body)))
        .when(role.isin("branchSummary", "compactionSummary"), F.array(e("content", strings.trim(said("$.message.summary")))))
    )
    entries = (
        F.when(entry == "message", of_message)
        .when(entry.isin("compaction", "branch_summary"), F.array(e("content", strings.trim(said("$.summary")))))
        .when((entry == "custom_message") & _not_hidden(v, "$.display"), F.array(e("content", content_text(v, "$.content"))))
    )
    opened = headers(lines).select("session_id")
    return (
        parsed(lines, counts)
        .join(opened, "session_id", "left_semi")
        .select("session_id", "chunk", F.col("off").alias("unit"), entries.alias("entries"))
        .select("session_id", "chunk", "unit", F.posexplode(F.array_compact("entries")).alias("seq", "e"))
        .select("session_id", "chunk", "unit", "seq", "e.kind", "e.text")
        .where(strings.trim("text") != "")
        .select(*TEXT_COLUMNS)
    )


def search_hits(lines: DataFrame, query: str) -> DataFrame:
    """In-session hits over text, tool name and tool input; a line may give several."""
    q = query.lower()
    rows = records(lines)
    # parts are joined by single blanks; missing ones leave nothing behind
    text = F.concat(
        "content",
        F.when(F.col("tool_name").isNotNull(), F.concat(F.lit(" "), "tool_name")).otherwise(""),
        F.when(F.col("tool_input").isNotNull(), F.concat(F.lit(" "), "tool_input")).otherwise(""),
    )
    label = F.when(F.col("tool_name").isNotNull(), "tool").otherwise(F.col("record_type"))
    return (
        rows.select("session_id", "unit", "seq", label.alias("record_type"), text.alias("text"), "ts")
        .where(F.contains(F.lower("text"), F.lit(q)))
        .select("session_id", "unit", "seq", "record_type", snippet(F.col("text"), q).alias("snippet"), "ts")
    )
