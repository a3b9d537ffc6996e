"""Dialect A: one JSON object per line, a message with content blocks, assistant turns streamed in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.functions import times
from skeinlog.functions import variants as V
from skeinlog.functions.text import may_hold, snippet
from skeinlog.operators.ordered import RunningSum, SumSince, Total, ordered_scan
from skeinlog.schemas import RECORD_COLUMNS, TEXT_COLUMNS, USAGE_COLUMNS

SOURCE = "claude"

# fixed values: result fields that may carry readable text, in lookup order
RESULT_TEXT_KEYS = ["content", "result", "stdout", "output", "text"]
# fixed values: record types that only point at session state
STATE_TYPES = ["last-prompt", "ai-title", "mode", "permission-mode", "agent-name", "file-history-snapshot"]
# fixed values: hook attachments that belong to one tool call
TOOL_HOOK_TYPES = ["hook_success", "hook_cancelled", "hook_non_blocking_error"]
TOOL_HOOK_EVENTS = ["PreToolUse", "PostToolUse", "PostToolUseFailure"]
# fixed values: attachments that are pure bookkeeping
SILENT_ATTACHMENTS = [
    "async_hook_response",
    "hook_additional_context",
    "deferred_tools_delta",
    "mcp_instructions_delta",
    "command_permissions",
    "ultra_effort_enter",
]
INTERACTIVE_TOOL = "AskUserQuestion"
# characters of one message that are put together; a longer one stays in pieces
TEXT_LIMIT = 1 << 26


def _block(b: Column) -> Column:
    return F.struct(
        V.get(b, "$.type").alias("type"),
        V.get(b, "$.text").alias("text"),
        V.get(b, "$.thinking").alias("thinking"),
        V.get(b, "$.id").alias("id"),
        V.get(b, "$.name").alias("name"),
        V.sub(b, "$.input").alias("input"),
        V.get(b, "$.tool_use_id").alias("tool_use_id"),
        V.sub(b, "$.content").alias("content"),
    )


def _content_text(c: Column) -> Column:
    """Readable text of a result ``content``: a non-empty string, or block texts joined by newlines."""
    parts = F.filter(
        F.transform(
            F.try_variant_get(c, "$", "array<variant>"), lambda i: F.coalesce(V.get(i, "$.text"), V.get(i, "$.content"))
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(F.schema_of_variant(c) == "STRING", F.nullif(V.get(c, "$"), F.lit(""))).when(
        F.size(parts) > 0, F.array_join(parts, "\n")
    )


def parsed(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    """Parse every valid line once and name the parts the rest of the dialect works on."""
    v = F.col("v")
    base = V.with_parsed(lines, counts=counts)
    base = base.select(
        "*",
        F.coalesce(V.get(v, "$.type"), F.lit("")).alias("rtype"),
        F.coalesce(V.get(v, "$.message.role"), F.lit("")).alias("role"),
        F.transform(V.array(v, "$.message.content"), _block).alias("blocks"),
        V.text(v, "$.message.content").alias("body"),
        V.text(v, "$.timestamp").alias("ts_raw"),
        V.sub(v, "$.toolUseResult").alias("tur"),
    )
    first_role = F.when(F.col("rtype").isin("", "message", "unknown") & (F.col("role") != ""), F.col("role")).otherwise(
        F.when(F.col("rtype") == "", "unknown").otherwise(F.col("rtype"))
    )
    has_result = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    return base.withColumn("kind", F.when((first_role == "user") & has_result, "tool_result").otherwise(first_role)).withColumn(
        "ts", times.local_text(F.col("ts_raw"))
    )


def _texts_of(kind: str, field: str) -> Column:
    return F.filter(
        F.transform(F.filter("blocks", lambda b: b["type"] == kind), lambda b: b[field]), lambda t: t.isNotNull()
    )


def user_text() -> Column:
    return F.coalesce(F.col("body"), V.first_of(_texts_of("text", "text")), F.lit(""))


def assistant_text() -> Column:
    return F.coalesce(F.array_join(_texts_of("text", "text"), " "), F.col("body"), F.lit(""))


def result_text() -> Column:
    from_blocks = V.first_of(
        F.filter(
            F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: _content_text(b["content"])),
            lambda t: t.isNotNull(),
        )
    )
    tur = F.col("tur")
    chain = [F.nullif(V.text(tur, "$"), F.lit(""))]
    chain += [F.nullif(V.text(tur, f"$.{k}"), F.lit("")) for k in RESULT_TEXT_KEYS]
    return F.coalesce(
        from_blocks, F.nullif(F.col("body"), F.lit("")), *chain, _content_text(V.sub(tur, "$.content")), F.lit("")
    )


def thinking_text(sep: str) -> Column:
    parts = F.filter(_texts_of("thinking", "thinking"), lambda t: t != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def preview() -> Column:
    kind = F.col("kind")
    return (
        F.when(kind == "user", user_text())
        .when(kind == "assistant", assistant_text())
        .when(kind == "tool_result", result_text())
        .when(kind == "system", F.coalesce(V.text(F.col("v"), "$.content"), F.lit("")))
        .otherwise("")
    )


def first_call() -> Column:
    return V.first_of(F.filter("blocks", lambda b: b["type"] == "tool_use"))


def result_id() -> Column:
    from_blocks = V.first_of(
        F.filter(
            F.transform(F.filter("blocks", lambda b: b["type"] == "tool_result"), lambda b: b["tool_use_id"]),
            lambda i: i.isNotNull(),
        )
    )
    return F.coalesce(V.text(F.col("tur"), "$.tool_use_id"), from_blocks)


def level(kind: Column, has_content: Column, v: Column, body: Column, tur: Column) -> Column:
    """content < tool < debug visibility of a non-call record."""
    return (
        F.when(
            kind == "user",
            F.when(~has_content | F.coalesce(strings.ltrim(body).startswith("<"), F.lit(False)), "debug").otherwise("content"),
        )
        .when(kind == "assistant", F.when(has_content, "content").otherwise("debug"))
        .when(kind == "tool_result", F.when(V.sub(tur, "$.answers").isNotNull(), "content").otherwise("tool"))
        .when(
            (kind == "system") & (F.coalesce(V.get(v, "$.subtype"), F.lit("")) == "compact_boundary"),
            "content",
        )
        .otherwise("debug")
    )


def visible(level_col: Column, min_level: str) -> Column:
    if min_level == "content":
        return level_col == "content"
    if min_level == "tool":
        return level_col != "debug"
    return F.lit(True)


def diff(tur: Column) -> Column:
    """File path and hunks of an edit result, as JSON."""
    hunks = F.filter(
        F.transform(
            V.array(tur, "$.structuredPatch"),
            lambda h: F.struct(
                V.number(h, "$.oldStart").alias("old_start"),
                V.number(h, "$.oldLines").alias("old_lines"),
                V.number(h, "$.newStart").alias("new_start"),
                V.number(h, "$.newLines").alias("new_lines"),
                F.try_variant_get(h, "$.lines", "array<string>").alias("lines"),
            ),
        ),
        lambda h: h["lines"].isNotNull(),
    )
    path = V.text(tur, "$.filePath")
    return F.when(path.isNotNull() & (F.size(hunks) > 0), F.to_json(F.struct(path.alias("file_path"), hunks.alias("hunks"))))


def result_meta(tur: Column) -> Column:
    """Small structured facts of a result, recognised by shape in a fixed order."""

    def present(key: str) -> Column:
        return V.sub(tur, f"$.{key}").isNotNull()

    def obj(name: str, **fields: Column) -> Column:
        return F.to_json(
            F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias(name)), {"ignoreNullFields": "false"}
        )

    def field(key: str) -> Column:
        return V.sub(tur, f"$.{key}")

    answers = F.try_variant_get(tur, "$.answers", "map<string,variant>")
    return (
        F.when(answers.isNotNull(), F.to_json(F.struct(field("answers").alias("answers"))))
        .when(
            present("code") & present("result"),
            obj(
                "webfetch",
                code=field("code"),
                code_text=field("codeText"),
                bytes=field("bytes"),
                duration_ms=field("durationMs"),
                url=field("url"),
            ),
        )
        .when(
            present("results") & present("query"),
            obj("websearch", count=field("searchCount"), duration_seconds=field("durationSeconds")),
        )
        .when(
            present("stdout") | present("stderr"),
            obj(
                "terminal",
                interrupted=field("interrupted"),
                background_task_id=field("backgroundTaskId"),
                exit_note=field("returnCodeInterpretation"),
                stderr=F.nullif(V.text(tur, "$.stderr"), F.lit("")),
            ),
        )
        .when(
            present("file"),
            obj(
                "read",
                file_path=field("file.filePath"),
                num_lines=field("file.numLines"),
                total_lines=field("file.totalLines"),
                start_line=field("file.startLine"),
                is_image=F.coalesce(V.get(tur, "$.type") == "image", F.lit(False)),
            ),
        )
        .when(
            present("mode"),
            obj(
                "grep",
                mode=field("mode"),
                num_files=field("numFiles"),
                num_lines=field("numLines"),
                truncated=field("appliedLimit"),
            ),
        )
        .when(present("filenames"), obj("glob", num_files=field("numFiles"), truncated=field("truncated")))
    )


def tool_hook(v: Column) -> Column:
    """(text, call id) of a hook that belongs to one call, null for anything else."""
    kind, event = V.get(v, "$.attachment.type"), V.get(v, "$.attachment.hookEvent")
    call = V.text(v, "$.attachment.toolUseID")
    name = F.coalesce(V.get(v, "$.attachment.hookName"), F.lit(""))
    tag = F.when(kind == "hook_cancelled", " (cancelled)").when(kind == "hook_non_blocking_error", " (error)").otherwise("")
    head = F.concat(
        F.lit("🪝 "),
        F.when(name == "", F.concat(event, tag))
        .when(name.startswith(event), F.concat(name, tag))
        .otherwise(F.concat(event, tag, F.lit(" · "), name)),
    )
    out = strings.trim(F.coalesce(V.text(v, "$.attachment.stdout"), F.lit("")))
    text = F.when(out == "", head).otherwise(F.concat(head, F.lit("\n"), out))
    fits = kind.isin(TOOL_HOOK_TYPES) & event.isin(TOOL_HOOK_EVENTS) & call.isNotNull()
    return F.when(fits, F.struct(text.alias("text"), call.alias("call_id")))


def meta_label(v: Column, kind: Column) -> Column:
    """Friendly label of a state pointer or attachment; null hides it below the debug view."""
    sub = F.coalesce(V.get(v, "$.attachment.type"), F.lit(""))

    def at(key: str) -> Column:
        return V.text(v, f"$.attachment.{key}")

    shown_path = F.coalesce(at("displayPath"), at("path"), F.lit(""))
    memory = F.coalesce(V.text(v, "$.attachment.content.content"), F.lit(""))
    out = strings.trim(F.coalesce(at("stdout"), F.lit("")))
    event = F.coalesce(at("hookEvent"), F.lit("Hook"))
    attachment = (
        F.when(sub == "queued_command", F.concat(F.lit("queued command: "), at("prompt")))
        .when(sub == "plan_mode", "plan mode entered")
        .when(sub == "plan_mode_exit", "plan mode left")
        .when(sub == "plan_mode_reentry", "plan mode entered again")
        .when(sub == "edited_text_file", F.concat(F.lit("edited file: "), at("filename")))
        .when(
            sub == "nested_memory",
            F.concat(F.lit("memory loaded: "), shown_path, F.when(memory == "", "").otherwise(F.concat(F.lit("\n\n"), memory))),
        )
        .when(sub == "task_reminder", F.concat(F.lit("task reminder: "), V.get(v, "$.attachment.itemCount")))
        .when(
            sub == "skill_listing",
            F.when(
                F.coalesce(V.get(v, "$.attachment.isInitial", "boolean"), F.lit(False)),
                F.concat(F.lit("skills loaded: "), V.get(v, "$.attachment.skillCount")),
            ),
        )
        .when(sub == "hook_success", F.concat(F.lit("🪝 "), event, F.when(out == "", "").otherwise(F.concat(F.lit("\n"), out))))
        .when(sub.isin(SILENT_ATTACHMENTS), F.lit(None).cast("string"))
        .otherwise(
            F.coalesce(F.nullif(at("content"), F.lit("")), F.when(sub != "", F.concat(F.lit("[attachment: "), sub, F.lit("]"))))
        )
    )
    return (
        F.when(kind == "ai-title", F.concat(F.lit("session title: "), V.text(v, "$.aiTitle")))
        .when(kind == "agent-name", F.concat(F.lit("current agent: "), V.text(v, "$.agentName")))
        .when(kind == "attachment", attachment)
    )


def raw_label(v: Column, kind: Column) -> Column:
    """Debug fallback: a one-line label, then the whole record as JSON."""
    sub = F.coalesce(V.get(v, "$.attachment.type"), F.lit("attachment"))
    label = F.when(kind == "attachment", F.concat_ws(" · ", F.lit("attachment"), sub, V.get(v, "$.attachment.hookEvent"))).otherwise(kind)
    return F.concat(F.lit("ⓘ "), label, F.lit("\n"), V.as_json(v))


def _record(seq: int, record_type, level_col, content, ts, **extra: Column) -> Column:
    fields = {
        "seq": F.lit(seq),
        "record_type": record_type if isinstance(record_type, Column) else F.lit(record_type),
        "level": level_col if isinstance(level_col, Column) else F.lit(level_col),
        "content": content,
        "ts": ts,
    }
    for name in ("tool_name", "tool_use_id", "tool_input", "result_meta", "diff"):
        fields[name] = extra.get(name, F.lit(None)).cast("string")
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _line_records(lines: DataFrame) -> DataFrame:
    """Records that map line by line: a pure projection, no shuffle."""
    v, kind, tur = F.col("v"), F.col("kind"), F.col("tur")
    is_assistant = kind == "assistant"
    rows = parsed(lines).withColumns({"hook": tool_hook(v), "content": preview(), "group_id": V.text(v, "$.message.id")})
    rows = rows.withColumn("think", F.when(is_assistant, thinking_text("\n")))
    hook = F.col("hook")
    is_meta = (kind == "attachment") | kind.isin(STATE_TYPES)
    is_result = kind == "tool_result"
    per_line = (
        F.when(is_assistant, F.when(F.col("think").isNotNull(), _record(0, "thinking", "content", F.col("think"), F.col("ts"))))
        .when(
            is_meta & hook.isNotNull(),
            _record(0, "hook", "debug", hook["text"], F.col("ts"), tool_use_id=hook["call_id"]),
        )
        .when(is_meta, _record(0, "meta", "debug", F.coalesce(meta_label(v, kind), raw_label(v, kind)), F.col("ts")))
        .otherwise(
            _record(
                0,
                kind,
                level(kind, F.col("content") != "", v, F.col("body"), tur),
                F.col("content"),
                F.col("ts"),
                tool_use_id=F.when(is_result, result_id()),
                result_meta=F.when(is_result, result_meta(tur)),
                diff=diff(tur),
            )
        )
    )
    return V.expand(rows, ["session_id", "chunk", F.col("off").alias("unit"), "group_id"], per_line)


def turn_rows(lines: DataFrame) -> DataFrame:
    """Assistant lines with their text, whether they close a message, and the facts of a closing line."""
    v = F.col("v")
    # raw-text gate below the parse: only lines that can be assistant turns are parsed here
    rows = parsed(lines.where(F.col("line").contains('"assistant"'))).where("kind = 'assistant'")
    asks = F.coalesce(F.exists("blocks", lambda b: (b["type"] == "tool_use") & (b["name"] == INTERACTIVE_TOOL)), F.lit(False))
    rows = rows.select(
        "session_id",
        "chunk",
        "off",
        "ts",
        V.text(v, "$.message.id").alias("group_id"),
        assistant_text().alias("content"),
        first_call().alias("call"),
        asks.alias("asks"),
        diff(F.col("tur")).alias("diff"),
        V.get(v, "$.message.stop_reason").isNotNull().alias("stops"),
    )
    return rows.select(
        "session_id",
        "chunk",
        "off",
        "ts",
        "content",
        (F.col("call.name").isNotNull() | F.col("stops")).alias("closes"),
        F.struct(
            "off",
            "chunk",
            "ts",
            "group_id",
            F.col("call.name").alias("tool_name"),
            F.col("call.id").alias("tool_use_id"),
            V.as_json(F.col("call.input")).alias("tool_input"),
            "asks",
            "diff",
        ).alias("line"),
    )


def merge_turns(rows: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """One row per message: every line up to and including a closing one (a call, or a stop reason).

    ``end`` holds the facts of the closing line; it is null for text that is still open (``tail``), and for the earlier pieces of a text of more than ``limit``
    characters. Such a text stays in pieces, each at its own last line: a row that comes after ``limit`` characters of its message, or a multiple,
    begins the next piece, so no task ever holds a message of any size.
    """
    one = F.lit(1).cast("bigint")
    specs = [
        RunningSum("island", F.col("closes").cast("bigint"), inclusive=False),
        SumSince("since", F.length("content").cast("bigint"), F.col("closes")),
        RunningSum("place", one),
        Total("places", one),
    ]
    rows = ordered_scan(rows, ["session_id"], ["off"], specs).withColumn("piece", F.floor(F.col("since") / limit))
    # first per chunk, on the partitioning the scan left behind, so that no task holds a long piece's lines
    has_text = F.col("content") != ""
    piece = F.when(has_text, F.struct("off", "content"))
    pieces = rows.groupBy("session_id", "chunk", "island", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["content"]), "").alias("part"),
        F.min(F.when(has_text, F.struct("off", "ts"))).alias("first"),
        F.max("off").alias("last_off"),
        F.first(F.when(F.col("closes"), F.col("line")), ignorenulls=True).alias("end"),
        F.max(F.col("place") == F.col("places")).alias("tail"),
    )
    islands = pieces.groupBy("session_id", "island", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda p: p["part"]), "").alias("text"),
        F.min("first").alias("first"),
        F.max(F.struct("last_off", "chunk")).alias("last"),
        F.first("end", ignorenulls=True).alias("end"),
        F.max("tail").alias("tail"),
    )
    return islands.select(
        "session_id",
        F.col("last.last_off").alias("off"),
        F.col("last.chunk").alias("chunk"),
        "text",
        F.col("first.ts").alias("text_ts"),
        "end",
        (F.col("tail") & F.col("end").isNull()).alias("tail"),
    )


def _turn_records(lines: DataFrame) -> DataFrame:
    """Assistant texts merged over their streamed chunks, and the calls that close them."""
    islands = merge_turns(turn_rows(lines))
    # text still open at the end of the session belongs to the session's last line
    last = lines.groupBy("session_id").agg(F.max(F.struct("off", "chunk")).alias("last"))
    open_islands = (
        islands.where("tail")
        .drop("off", "chunk")
        .join(last, "session_id")
        .select("session_id", F.col("last.chunk").alias("chunk"), F.col("last.off").alias("unit"), "text", "text_ts", "end")
    )
    closed = islands.where("not tail").select("session_id", "chunk", F.col("off").alias("unit"), "text", "text_ts", "end")
    ts = F.coalesce(F.col("text_ts"), F.col("end.ts"))
    entries = [
        F.when(F.col("text") != "", _record(1, "assistant", "content", F.col("text"), ts)),
        F.when(
            F.col("end.tool_name").isNotNull(),
            _record(
                2,
                "assistant",
                F.when(F.col("end.asks"), "content").otherwise("tool"),
                F.lit(""),
                ts,
                tool_name=F.col("end.tool_name"),
                tool_use_id=F.col("end.tool_use_id"),
                tool_input=F.col("end.tool_input"),
                diff=F.col("end.diff"),
            ),
        ),
    ]
    keep = ["session_id", "chunk", "unit", F.col("end.group_id").alias("group_id")]
    return V.expand(closed.unionByName(open_islands), keep, *entries)


def records(lines: DataFrame, min_level: str = "debug") -> DataFrame:
    """Timeline records at a visibility level, streamed assistant chunks merged into whole messages."""
    result = _line_records(lines).unionByName(_turn_records(lines))
    return result.where(visible(F.col("level"), min_level)).select(*RECORD_COLUMNS)


# --- session level ---------------------------------------------------------------------------------


def _is_turn(kind: str) -> Column:
    return (F.col("rtype") == kind) | (F.col("role") == kind)


def index_text() -> Column:
    """Searchable conversation text of a user or assistant line; injected context gives ''."""
    joined = F.array_join(_texts_of("text", "text"), " ")
    return F.coalesce(F.when(F.col("body").startswith("<"), "").otherwise(F.col("body")), joined, F.lit(""))


def texts(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    rows = parsed(lines, counts)
    tur = F.col("tur")
    tool = F.coalesce(V.text(tur, "$"), *[V.text(tur, f"$.{k}") for k in RESULT_TEXT_KEYS])
    think = F.array_join(_texts_of("thinking", "thinking"), " ")

    def entry(seq: int, kind: str, cond: Column, text: Column) -> Column:
        keep = F.coalesce(cond & (strings.trim(text) != ""), F.lit(False))
        return F.when(keep, F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text")))

    entries = [
        entry(0, "content", F.col("rtype").isin("user", "assistant"), index_text()),
        entry(1, "reasoning", F.col("rtype") == "assistant", think),
        entry(2, "tool", tur.isNotNull(), tool),
    ]
    return V.expand(rows, ["session_id", "chunk", F.col("off").alias("unit")], *entries).select(*TEXT_COLUMNS)


def turn_usage() -> Column:
    """Counters of one assistant line; cache is read plus creation, the total is the sum of all."""
    v = F.col("v")
    base = "$.message.usage"
    inp, out = V.number(v, f"{base}.input_tokens"), V.number(v, f"{base}.output_tokens")
    cache = V.number(v, f"{base}.cache_read_input_tokens") + V.number(v, f"{base}.cache_creation_input_tokens")
    counters = F.struct(*[c.alias(n) for n, c in zip(USAGE_COLUMNS, (inp, out, cache, inp + out + cache), strict=True)])
    return F.when(_is_turn("assistant") & V.sub(v, base).isNotNull(), counters)


def summed_usage(column: str = "usage") -> list[Column]:
    zero = F.lit(0).cast("bigint")
    return [F.coalesce(F.sum(F.col(column)[c]), zero).cast("bigint").alias(c) for c in USAGE_COLUMNS]


def model_turns(lines: DataFrame) -> DataFrame:
    """(session_id, off, provider, model, thinking_level) of every turn that names a model."""
    return (
        parsed(lines)
        .where(_is_turn("assistant"))
        .select(
            "session_id",
            "off",
            F.lit(None).cast("string").alias("provider"),
            V.blank_to_null(V.text(F.col("v"), "$.message.model")).alias("model"),
            F.lit(None).cast("string").alias("thinking_level"),
        )
    )


def usage_by_turn_model(lines: DataFrame) -> DataFrame:
    """Usage attributed to the model named by each turn."""
    model = V.blank_to_null(V.text(F.col("v"), "$.message.model"))
    turns = parsed(lines).select(model.alias("model"), turn_usage().alias("usage")).where("usage is not null")
    return turns.groupBy("model").agg(F.count("*").alias("turns"), *summed_usage())


def sessions(lines: DataFrame) -> DataFrame:
    """One row per session: title, first prompt, created / updated and usage, in one aggregation.

    Only narrow columns reach the aggregation; the parsed line stays behind in the projection.
    """
    v, off = F.col("v"), F.col("off")
    rtype = F.col("rtype")
    summary = F.when(rtype == "summary", V.blank_to_null(V.text(v, "$.summary")))
    custom = F.when(
        rtype == "custom-title",
        V.blank_to_null(V.text(F.coalesce(V.sub(v, "$.customTitle"), V.sub(v, "$.title")), "$")),
    )
    turn_ts = F.when(_is_turn("user") | _is_turn("assistant"), F.col("ts"))
    prompt = index_text()
    is_prompt = (
        (rtype == "user") & (prompt != "") & ~F.coalesce(V.get(v, "$.isCompactSummary", "boolean"), F.lit(False))
    )
    cwd = V.text(v, "$.cwd")

    def at(value: Column) -> Column:
        return F.when(value.isNotNull(), off)

    rows = parsed(lines).select(
        "session_id",
        "off",
        turn_usage().alias("usage"),
        summary.alias("summary"),
        custom.alias("custom"),
        turn_ts.alias("turn_ts"),
        F.when(is_prompt, prompt).alias("prompt"),
        F.when(cwd.startswith("/"), cwd).alias("cwd"),
    )
    return rows.groupBy("session_id").agg(
        F.coalesce(
            F.max_by("custom", at(F.col("custom"))), F.max_by("summary", at(F.col("summary")))
        ).alias("agent_title"),
        F.min_by("prompt", at(F.col("prompt"))).alias("first_prompt"),
        F.min_by("turn_ts", at(F.col("turn_ts"))).alias("created_at"),
        F.max_by("turn_ts", at(F.col("turn_ts"))).alias("updated_at"),
        F.min_by("cwd", at(F.col("cwd"))).alias("project_path"),
        *summed_usage(),
    )


def lazy_first_prompt(lines: DataFrame) -> DataFrame:
    """First string prompt of a session (no injected-context rule)."""
    v = F.col("v")
    prompts = V.with_parsed(lines.select("session_id", "off", "line")).where(
        (V.get(v, "$.type") == "user") & ~F.coalesce(V.get(v, "$.isCompactSummary", "boolean"), F.lit(False))
    ).select("session_id", "off", V.text(v, "$.message.content").alias("prompt"))
    return (
        prompts.where("prompt is not null")
        .groupBy("session_id")
        .agg(F.min_by("prompt", "off").alias("first_prompt"))
    )


def search_hits(lines: DataFrame, query: str) -> DataFrame:
    """All in-session hits: text first, then thinking, then tool output; at most one hit per line."""
    q = query.lower()
    rows = parsed(lines.where(may_hold(F.col("line"), q)))
    kind = F.col("kind")

    def match(text: Column) -> Column:
        return F.contains(F.lower(text), F.lit(q))

    body = F.when(kind == "user", user_text()).when(kind == "assistant", assistant_text())
    think = F.when(kind == "assistant", thinking_text("\n"))
    result = F.when((kind == "tool_result") | F.col("tur").isNotNull(), result_text())

    def hit(t: Column, label) -> Column:
        return F.struct(t.alias("text"), (label if isinstance(label, Column) else F.lit(label)).alias("record_type"))

    found = F.coalesce(
        F.when(match(body) & ~strings.ltrim(body).startswith("<"), hit(body, kind)),
        F.when(match(think), hit(think, "thinking")),
        F.when(match(result), hit(result, "tool_result")),
    )
    return (
        V.expand(rows, ["session_id", F.col("off").alias("unit"), "ts"], found)
        .select("session_id", "unit", "record_type", snippet(F.col("text"), q).alias("snippet"), "ts")
    )


def bad_lines(lines: DataFrame) -> DataFrame:
    """Failure accounting: lines read and lines that are not JSON, per session."""
    blank = strings.trim(F.translate("line", "\r\n\t", "   ")) == ""
    bad = V.parse("line").isNull() & ~blank
    return lines.groupBy("session_id").agg(
        F.count("*").alias("lines"), F.sum(bad.cast("bigint")).alias("failed")
    )


def sidecar_subagents(metas: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Sub-agents of a session from their metadata files, with an estimated record count.

    ``metas(path, content)``, ``transcripts(path, size)``; the estimate is one record per 400 bytes.
    """
    v = F.col("v")
    home = r"([^/]+)/subagents/([^/]+?)(?:\.meta)?\.json$"
    stem = r"([^/]+)/subagents/([^/]+)\.jsonl$"
    rows = metas.select(
        F.regexp_extract("path", home, 1).alias("session_id"), F.regexp_extract("path", home, 2).alias("agent_id"), V.parse("content").alias("v")
    ).where("v is not null")
    named = rows.select(
        "session_id", "agent_id", V.text(v, "$.agentType").alias("agent_type"), V.text(v, "$.description").alias("description"), V.text(v, "$.toolUseId").alias("tool_use_id")
    ).where("agent_type is not null and description is not null and tool_use_id is not null")
    sizes = transcripts.select(
        F.regexp_extract("path", stem, 1).alias("session_id"), F.regexp_extract("path", stem, 2).alias("agent_id"), F.col("size").cast("bigint").alias("size")
    )
    estimate = F.when(F.col("size").isNull(), F.lit(0)).otherwise(F.greatest(F.floor(F.col("size") / 400), F.lit(1))).cast("bigint")
    return named.join(sizes, ["session_id", "agent_id"], "left").withColumn("record_count", estimate).drop("size")


def with_files(session_rows: DataFrame, files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sessions with the facts of their file: size, version, sub-agent count; file times fill missing ones.

    ``files(session_id, path, size, created, mtime)``, ``sidecars(session_id, agent_id, ...)``.
    """
    counts = sidecars.groupBy("session_id").agg(F.count("*").alias("subagent_count"))
    facts = files.select(
        "session_id",
        F.col("path").alias("key"),
        F.concat_ws(":", F.col("size").cast("string"), F.unix_timestamp("mtime").cast("string")).alias("version"),
        F.col("size").cast("bigint").alias("file_size_bytes"),
        F.date_format("created", times.SECOND).alias("file_created"),
        F.date_format("mtime", times.SECOND).alias("file_updated"),
    )
    joined = session_rows.join(facts, "session_id", "left").join(counts, "session_id", "left")
    return joined.withColumns(
        {
            "created_at": F.coalesce("created_at", "file_created"),
            "updated_at": F.coalesce("updated_at", "file_updated"),
            "subagent_count": F.coalesce("subagent_count", F.lit(0).cast("bigint")),
        }
    ).drop("file_created", "file_updated")
