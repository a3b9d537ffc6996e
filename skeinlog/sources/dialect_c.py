"""Dialect C: relational store of sessions, messages and parts, JSON payloads in ``data``.

``sessions(id, parent_id, directory, title, model, time_created, time_updated)``,
``messages(id, session_id, data, time_created)``, ``parts(id, message_id, session_id, data, time_created)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from skeinlog.functions import strings, times
from skeinlog.functions import text as X
from skeinlog.functions import variants as V
from skeinlog.operators.ordered import CHUNK_ROWS, equal_depth_chunk, row_position
from skeinlog.operators.tree import resolve_roots
from skeinlog.schemas import RECORD_COLUMNS, TEXT_COLUMNS
from skeinlog.sources.dialect_a import visible

SOURCE = "opencode"

# texts of a session in slices of a day
DAY_MS = 86_400_000


def message_positions(messages: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """Messages with their zero-based position in (time_created, id) order of the session.

    Sessions with more than ``rows`` messages are cut into slices of about as many, however close in time they lie.
    """
    chunked = equal_depth_chunk(messages, ["session_id"], "time_created", rows, "positions")
    return row_position(chunked, ["session_id"], ["time_created", "id"], "position")


def _as_text(v: Column) -> Column:
    return F.coalesce(V.get(v, "$"), F.lit(""))


def _terminal_error() -> Column:
    return F.lit('{"terminal":{"exit_code":1}}')


def question_answers(state: Column) -> Column:
    """Question text to chosen labels, paired by position."""
    questions = V.array(state, "$.input.questions")
    answers = V.array(state, "$.metadata.answers")
    pairs = F.filter(
        F.transform(
            questions,
            lambda q, i: F.struct(V.get(q, "$.question").alias("k"), F.coalesce(F.get(answers, i), F.parse_json(F.lit("[]"))).alias("v")),
        ),
        lambda p: p["k"].isNotNull(),
    )

    def quoted(c: Column) -> Column:
        wrapped = F.to_json(F.array(c))
        return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)

    body = F.array_join(F.transform(pairs, lambda p: F.concat(quoted(p["k"]), F.lit(":"), F.to_json(p["v"]))), ",")
    return F.when(F.size(pairs) > 0, F.concat(F.lit('{"answers":{'), body, F.lit("}}")))


def _input_json(v: Column) -> Column:
    """Call input with ``filePath`` renamed to ``file_path``."""
    fields = F.try_variant_get(v, "$.state.input", "map<string,variant>")
    renamed = F.transform_keys(fields, lambda k, _: F.when(k == "filePath", F.lit("file_path")).otherwise(k))
    plain = V.as_json(V.sub(v, "$.state.input"))
    return F.when(F.array_contains(F.map_keys(fields), "filePath") & ~F.array_contains(F.map_keys(fields), "file_path"), F.to_json(renamed)).otherwise(plain)


def records(messages: DataFrame, parts: DataFrame, min_level: str = "debug") -> DataFrame:
    """Timeline records: a tool part gives its call and, unless still running, its result."""
    positions = message_positions(messages).select(
        F.col("id").alias("message_id"), "chunk", "position", V.get(V.parse("data"), "$.role").alias("role"),
        times.millis_text(F.col("time_created")).alias("ts"),
    )
    v = F.col("v")
    rows = (
        V.with_parsed(parts.select("message_id", "session_id", F.col("id").alias("part_id"), "time_created", "data"), "data")
        .join(positions, "message_id")
    )
    kind = F.coalesce(V.get(v, "$.type"), F.lit(""))
    text = F.coalesce(V.text(v, "$.text"), F.lit(""))
    name = F.coalesce(V.text(v, "$.tool"), F.lit("tool"))
    call_id = V.text(v, "$.callID")
    status = F.coalesce(V.get(v, "$.state.status"), F.lit(""))
    level = F.when(name == "question", "content").otherwise("tool")

    def rec(record_type, lvl, content, **extra) -> Column:
        cols = {
            "record_type": F.lit(record_type) if isinstance(record_type, str) else record_type,
            "level": F.lit(lvl) if isinstance(lvl, str) else lvl,
            "content": content,
        }
        for n in ("tool_name", "tool_use_id", "tool_input", "result_meta"):
            cols[n] = extra.get(n, F.lit(None)).cast("string")
        return F.struct(*[c.alias(n) for n, c in cols.items()])

    edit_diff = V.text(v, "$.state.metadata.diff")
    call_input = F.when(
        name == "edit",
        F.when(edit_diff.isNotNull(), F.to_json(F.struct(edit_diff.alias("input")))).otherwise(V.as_json(V.sub(v, "$.state.input"))),
    ).otherwise(_input_json(v))
    raw_output = _as_text(V.sub(v, "$.state.output"))
    output = (
        F.when(name == "read", X.unwrap_read(raw_output))
        .when(name == "write", F.coalesce(V.text(v, "$.state.input.content"), raw_output))
        .otherwise(raw_output)
    )
    meta = F.when(name == "question", question_answers(V.sub(v, "$.state"))).when(status == "error", _terminal_error())
    call = rec("assistant", level, F.lit(""), tool_name=F.when(name == "task", "Agent").otherwise(name), tool_use_id=call_id, tool_input=call_input)
    result = rec("tool_result", level, output, tool_use_id=call_id, result_meta=meta)
    files = F.coalesce(F.try_variant_get(v, "$.files", "array<string>"), F.expr("cast(array() as array<string>)"))

    def tok(path: str) -> Column:
        return V.number(v, f"$.tokens.{path}", signed=True).cast("string")

    usage = F.concat(
        F.lit("tokens · input "), tok("input"), F.lit(" · output "), tok("output"), F.lit(" · reasoning "), tok("reasoning"),
        F.lit(" · cache read "), tok("cache.read"), F.lit(" write "), tok("cache.write"),
    )
    entries = (
        F.when(
            kind == "text",
            F.array(F.when(strings.trim(text) != "", rec(F.when(F.col("role") == "assistant", "assistant").otherwise("user"), "content", text))),
        )
        .when(kind == "reasoning", F.array(F.when(strings.trim(text) != "", rec("thinking", "content", text))))
        .when(kind == "tool", F.array(call, F.when(status != "running", result)))
        .when(
            kind == "patch",
            F.array(
                rec("assistant", "tool", F.lit(""), tool_name=F.lit("patch"), tool_use_id=V.text(v, "$.hash"),
                    tool_input=F.to_json(F.struct(files.alias("files"), V.text(v, "$.hash").alias("hash"))))
            ),
        )
        .when(kind == "step-finish", F.array(rec("usage", "debug", usage)))
        .when(kind == "compaction", F.array(rec("meta", "content", F.lit("context compacted"))))
    )
    staged = rows.select("session_id", "chunk", "position", "message_id", "time_created", "part_id", "ts", entries.alias("entries"))
    emitted = staged.select(
        "session_id", "chunk", "position", "message_id", "time_created", "part_id", "ts", F.posexplode("entries").alias("i", "r")
    ).where(F.col("r").isNotNull() & visible(F.col("r.level"), min_level))
    # record index inside its message: a message is the unit of a cursor and small
    inside = Window.partitionBy("session_id", "message_id").orderBy("time_created", "part_id", "i")
    return emitted.select(
        "session_id", "chunk", F.col("position").alias("unit"), (F.row_number().over(inside) - 1).alias("seq"), "r.*", "ts",
        F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("diff"),
    ).select(*RECORD_COLUMNS)


# --- session level -----------------------------------------------------------------------------------


def roots(sessions: DataFrame, label: str = "c-roots") -> DataFrame:
    """(session_id, root_id) at any depth; below a parent that has no row, the root is that parent's id."""
    known = sessions.select(F.col("id").alias("next"))
    pointers = sessions.select("id", "parent_id").join(known, F.col("parent_id") == F.col("next"), "left")
    missing = pointers.where("next is null and parent_id is not null").select(F.col("id").alias("root_id"), F.col("parent_id").alias("missing"))
    tops = resolve_roots(pointers.select("id", "next"), label)
    return tops.join(missing, "root_id", "left").select(F.col("id").alias("session_id"), F.coalesce("missing", "root_id").alias("root_id"))


def usage(parts: DataFrame, session_roots: DataFrame) -> DataFrame:
    """Step usage summed per session first, then per root."""
    v = F.col("v")
    steps = (
        parts.where(F.col("data").contains("step-finish"))
        .select("session_id", V.parse("data").alias("v"))
        .where(V.get(v, "$.type") == "step-finish")
    )
    cache = V.number(v, "$.tokens.cache.read") + V.number(v, "$.tokens.cache.write")
    inp, out = V.number(v, "$.tokens.input"), V.number(v, "$.tokens.output") + V.number(v, "$.tokens.reasoning")
    per_session = steps.groupBy("session_id").agg(
        F.sum(inp).alias("input_tokens"), F.sum(out).alias("output_tokens"), F.sum(cache).alias("cache_tokens"),
        F.sum(inp + out + cache).alias("total_tokens"),
    )
    return (
        per_session.join(session_roots, "session_id")
        .groupBy(F.col("root_id").alias("session_id"))
        .agg(*[F.sum(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cache_tokens", "total_tokens")])
    )


def texts(parts: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Searchable texts of every session, in store order (time_created, id)."""
    v = F.col("v")
    kind = V.get(v, "$.type")
    plain = F.coalesce(V.text(v, "$.text"), F.lit(""))
    tool = F.concat(F.coalesce(V.as_json(V.sub(v, "$.state.input")), F.lit("")), F.lit(" "), _as_text(V.sub(v, "$.state.output")))
    rows = V.with_parsed(parts.withColumn("chunk", F.floor(F.col("time_created") / DAY_MS).cast("bigint")), "data", counts)
    found = (
        F.when(kind == "text", F.struct(F.lit("content").alias("kind"), plain.alias("text")))
        .when(kind == "reasoning", F.struct(F.lit("reasoning").alias("kind"), plain.alias("text")))
        .when(kind == "tool", F.struct(F.lit("tool").alias("kind"), tool.alias("text")))
    )
    return (
        V.expand(rows, ["session_id", "chunk", F.col("time_created").alias("unit"), F.col("id").alias("seq")], found)
        .where(strings.trim("text") != "")
        .select(*TEXT_COLUMNS)
    )


def model_turns(sessions: DataFrame, messages: DataFrame, session_roots: DataFrame) -> DataFrame:
    """Models named by the session rows first, then by messages, on the root session."""
    v = F.col("v")

    def variant_name(path: str) -> Column:
        return F.nullif(V.text(v, f"{path}.variant"), F.lit("default"))

    def context(base: str) -> Column:
        whole = V.text(v, base)
        obj = F.try_variant_get(v, base, "map<string,variant>").isNotNull()
        return F.when(
            whole.isNotNull(),
            F.struct(F.lit(None).cast("string").alias("provider"), whole.alias("model"), F.lit(None).cast("string").alias("thinking_level")),
        ).when(
            obj,
            F.struct(
                V.text(v, f"{base}.providerID").alias("provider"),
                F.coalesce(V.text(v, f"{base}.modelID"), V.text(v, f"{base}.id")).alias("model"),
                variant_name(base).alias("thinking_level"),
            ),
        )

    own = sessions.where("model is not null and model <> ''").select(
        F.col("id").alias("session_id"), F.lit(-1).cast("bigint").alias("off"), V.parse("model").alias("v")
    )
    own = own.select("session_id", "off", context("$").alias("m"))
    gate = F.col("data").contains('"model') | F.col("data").contains('"providerID"')
    said = messages.where(gate).select("session_id", F.col("time_created").alias("off"), V.parse("data").alias("v"))
    flat = F.when(
        V.sub(v, "$.providerID").isNotNull() | V.sub(v, "$.modelID").isNotNull(),
        F.struct(
            V.text(v, "$.providerID").alias("provider"), V.text(v, "$.modelID").alias("model"), variant_name("$").alias("thinking_level")
        ),
    )
    said = said.select("session_id", "off", F.explode(F.array(flat, context("$.model"))).alias("m"))
    rows = own.unionByName(said).where("m is not null")
    return rows.select(
        "session_id", "off", *[V.blank_to_null(F.col(f"m.{c}")).alias(c) for c in ("provider", "model", "thinking_level")]
    ).join(session_roots, "session_id").select(F.col("root_id").alias("session_id"), "off", "provider", "model", "thinking_level")


def session_list(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Top sessions with message and direct child counts; minute-precision times."""
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("messages"))
    children = sessions.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    zero = F.lit(0).cast("bigint")
    return (
        sessions.where("parent_id is null")
        .join(counts, "id", "left")
        .join(children, "id", "left")
        .select(
            F.col("id").alias("session_id"),
            F.coalesce("directory", F.lit("")).alias("project_path"),
            V.blank_to_null(F.col("title")).alias("agent_title"),
            times.millis_text(F.col("time_created"), times.MINUTE).alias("created_at"),
            times.millis_text(F.col("time_updated"), times.MINUTE).alias("updated_at"),
            F.coalesce("messages", zero).alias("message_count"),
            (F.coalesce("messages", zero) * 400).alias("file_size_bytes"),
            F.coalesce("children", zero).alias("subagent_count"),
        )
    )


def orphaned(sessions: DataFrame, session_roots: DataFrame) -> DataFrame:
    """Sessions whose root is no listed top session; they yield no document."""
    top = sessions.where("parent_id is null").select(F.col("id").alias("root_id"))
    return session_roots.join(top, "root_id", "left_anti")


def subagents(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Child sessions with the task call that opened them, found through the part's metadata."""
    v = F.col("v")
    tasks = (
        parts.where(F.col("data").contains('"tool":"task"'))
        .select("session_id", "time_created", "id", V.parse("data").alias("v"))
        .select(
            F.col("session_id").alias("parent_id"),
            F.struct("time_created", "id").alias("at"),
            V.text(v, "$.state.metadata.sessionId").alias("id"),
            F.coalesce(V.text(v, "$.callID"), F.lit("")).alias("tool_use_id"),
            F.coalesce(V.text(v, "$.state.metadata.agent"), V.text(v, "$.state.input.subagent_type"), F.lit("subagent")).alias("agent_type"),
        )
        .where("id is not null and id <> ''")
        .groupBy("parent_id", "id")
        .agg(F.max_by(F.struct("tool_use_id", "agent_type"), "at").alias("task"))
    )
    counts = messages.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    return (
        sessions.where("parent_id is not null")
        .select("parent_id", "id", "title")
        .join(tasks, ["parent_id", "id"], "left")
        .join(counts, "id", "left")
        .select(
            F.col("parent_id").alias("session_id"),
            F.col("id").alias("agent_id"),
            F.coalesce(F.nullif(F.col("task.agent_type"), F.lit("")), F.lit("subagent")).alias("agent_type"),
            F.coalesce("title", F.lit("")).alias("description"),
            F.coalesce("task.tool_use_id", F.lit("")).alias("tool_use_id"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("record_count"),
        )
    )


def index_first_prompt(parts: DataFrame, session_roots: DataFrame) -> DataFrame:
    """First conversation text of any role below a root."""
    rows = texts(parts).where("kind = 'content'")
    per_session = rows.groupBy("session_id").agg(F.min_by(F.struct("unit", "seq", "text"), F.struct("unit", "seq")).alias("f"))
    return (
        per_session.join(session_roots, "session_id")
        .groupBy(F.col("root_id").alias("session_id"))
        .agg(F.min_by("f.text", F.struct("f.unit", "f.seq")).alias("first_prompt"))
    )


def user_first_prompt(messages: DataFrame, parts: DataFrame) -> DataFrame:
    """First user text of a session."""
    m = messages.select(F.col("id").alias("message_id"), F.col("time_created").alias("m_time"), F.col("data").alias("m_data"))
    joined = parts.join(m, "message_id")
    text = strings.trim(V.text(V.parse("data"), "$.text"))
    rows = joined.where((V.get(V.parse("m_data"), "$.role") == "user") & (V.get(V.parse("data"), "$.type") == "text"))
    return (
        rows.select("session_id", F.struct("m_time", "message_id", "time_created", "id").alias("at"), text.alias("text"))
        .where("text <> ''")
        .groupBy("session_id")
        .agg(F.min_by("text", "at").alias("first_prompt"))
    )


def search_hits(messages: DataFrame, parts: DataFrame, query: str) -> DataFrame:
    """In-session hits; the cursor is the message position."""
    q = query.lower()
    labels = F.when(F.col("kind") == "content", "message").when(F.col("kind") == "reasoning", "thinking").otherwise("tool_result")
    found = texts(parts.where(X.may_hold(F.col("data"), q))).where(F.contains(F.lower("text"), F.lit(q)))
    owners = parts.select(F.col("id").alias("seq"), "message_id")
    positions = message_positions(messages).select(F.col("id").alias("message_id"), "position")
    return (
        found.join(owners, "seq")
        .join(positions, "message_id")
        .select("session_id", F.col("position").alias("unit"), labels.alias("record_type"), X.snippet(F.col("text"), q).alias("snippet"))
    )
