"""Dialect B: ``type`` + ``payload`` envelopes, one rollout file per thread, threads form trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.functions import text as X
from skeinlog.functions import times
from skeinlog.functions import variants as V
from skeinlog.functions.text import snippet
from skeinlog.operators.models import context_arrays
from skeinlog.operators.ordered import LastValue, ordered_scan
from skeinlog.operators.tree import next_pointers, resolve_roots
from skeinlog.schemas import RECORD_COLUMNS, TEXT_COLUMNS, USAGE_COLUMNS
from skeinlog.session import cut_lineage
from skeinlog.sources.dialect_a import visible
from skeinlog.sources.files import group_version

SOURCE = "codex"

# fixed values: calls that ask the user
ASK_CALLS = ["request_user_input", "ask_user_question"]


def parsed(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    v = F.col("v")
    base = V.with_parsed(lines, counts=counts)
    return base.select(
        "*",
        F.coalesce(V.get(v, "$.type"), F.lit("")).alias("t"),
        F.coalesce(V.get(v, "$.payload.type"), F.lit("")).alias("pt"),
        times.local_text(V.text(v, "$.timestamp")).alias("ts"),
    )


def block_text(v: Column, path: str) -> Column:
    """A string as it is; an array gives the texts of its blocks without a separator."""
    parts = F.filter(F.transform(V.array(v, path), lambda b: V.get(b, "$.text")), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(parts, ""), V.text(v, path), F.lit(""))


def _clean(v: Column, *paths: str) -> Column:
    return F.coalesce(*[V.blank_to_null(V.text(v, p)) for p in paths])


def effort(v: Column) -> Column:
    return F.coalesce(V.text(v, "$.payload.effort"), V.text(v, "$.payload.effort.effort"))


def identities(lines: DataFrame) -> DataFrame:
    """One row per file from its first header; later headers are inherited history and do not count."""
    v = F.col("v")
    rows = V.with_parsed(lines.where(F.col("line").contains('"session_meta"'))).where(V.get(v, "$.type") == "session_meta")
    spawn = "$.payload.source.subagent.thread_spawn"
    places = {
        "id": "$.payload.id",
        "session": "$.payload.session_id",
        "parent": "$.payload.parent_thread_id",
        "spawn_parent": f"{spawn}.parent_thread_id",
        "origin": "$.payload.thread_source",
        "forked": "$.payload.forked_from_id",
        "cwd": "$.payload.cwd",
        "path": "$.payload.agent_path",
        "spawn_path": f"{spawn}.agent_path",
        "nickname": "$.payload.agent_nickname",
        "spawn_nickname": f"{spawn}.agent_nickname",
        "role": "$.payload.agent_role",
        "spawn_role": f"{spawn}.agent_role",
    }
    # every field is looked up once: an expression that is named twice is computed twice
    as_is = {"provider": V.text(v, "$.payload.model_provider"), "at": V.text(v, "$.payload.timestamp"), "line_at": V.text(v, "$.timestamp")}
    found = [c.alias(n) for n, c in ({n: V.text(v, p) for n, p in places.items()} | as_is).items()]
    rows = rows.select("session_id", "off", *found, V.sub(v, "$.payload.source.subagent").isNotNull().alias("spawned"))
    rows = rows.select("session_id", "off", "provider", "spawned", F.coalesce("at", "line_at").alias("at"), *[V.blank_to_null(F.col(n)).alias(n) for n in places])
    thread, parent = F.coalesce("id", "session"), F.coalesce("parent", "spawn_parent")
    is_sub = (
        F.coalesce(F.col("origin") == "subagent", F.lit(False))
        | F.col("spawned")
        | parent.isNotNull()
        | F.coalesce(F.col("session") != thread, F.lit(False))
    )
    fields = F.struct(
        thread.alias("thread_id"),
        F.col("session").alias("root_hint"),
        F.when(is_sub, F.coalesce(parent, "forked")).alias("parent_id"),
        is_sub.alias("is_subagent"),
        F.coalesce("cwd", F.lit("")).alias("cwd"),
        times.local_text(F.col("at")).alias("started"),
        F.col("provider").alias("provider"),
        F.coalesce("path", "spawn_path").alias("agent_path"),
        F.coalesce("nickname", "spawn_nickname").alias("agent_nickname"),
        F.coalesce("role", "spawn_role").alias("agent_role"),
    )
    firsts = rows.select("session_id", "off", fields.alias("m")).groupBy("session_id").agg(F.min_by("m", "off").alias("m"))
    return firsts.select("session_id", "m.*").where("thread_id is not null")


def threads(ident: DataFrame, label: str = "threads") -> DataFrame:
    """Identities with their resolved root thread. The identities are written once: every round reads them."""
    ident = cut_lineage(ident, f"{label}-identities")
    nodes = ident.groupBy(F.col("thread_id").alias("id")).agg(
        F.min_by(F.struct("parent_id", "root_hint", "is_subagent"), "session_id").alias("n")
    )
    nodes = nodes.select("id", "n.*")
    roots = resolve_roots(next_pointers(nodes), label)
    return ident.join(roots.withColumnRenamed("id", "thread_id"), "thread_id")


def _usage(v: Column) -> Column:
    base = "$.payload.info.total_token_usage"
    names = ["input_tokens", "output_tokens", "cached_input_tokens", "total_tokens"]
    return F.struct(*[V.number(v, f"{base}.{n}").alias(c) for n, c in zip(names, USAGE_COLUMNS, strict=True)])


def counters(lines: DataFrame) -> DataFrame:
    """Token counters and agent messages of every file, in order."""
    v = F.col("v")
    gate = F.col("line").contains('"token_count"') | F.col("line").contains('"agent_message"')
    rows = parsed(lines.where(gate))
    is_count = (
        (F.col("t") == "event_msg") & (F.col("pt") == "token_count") & V.sub(v, "$.payload.info.total_token_usage").isNotNull()
    )
    is_msg = (F.col("t") == "response_item") & (F.col("pt") == "agent_message")
    return rows.where(is_count | is_msg).select(
        "session_id",
        "chunk",
        "off",
        F.when(is_count, _usage(v)).alias("usage"),
        is_msg.alias("is_msg"),
        F.when(is_msg, V.text(v, "$.payload.recipient")).alias("recipient"),
    )


def latest_usage(lines: DataFrame) -> DataFrame:
    """Counters are cumulative: the last one of a file wins."""
    rows = counters(lines).where("usage is not null")
    return rows.groupBy("session_id").agg(F.max_by("usage", "off").alias("usage")).select("session_id", "usage.*")


def own_usage(lines: DataFrame, ident: DataFrame) -> DataFrame:
    """Usage of a thread itself: a sub-agent's copied history is subtracted.

    The baseline is the last counter seen before the first message addressed to the agent's own path
    (a missing recipient matches a missing path). It is carried along by an ordered scan and folded to one row
    per (file, recipient) before it meets the identities, so no file is gathered whole.
    """
    rows = counters(lines)
    seen = ordered_scan(rows, ["session_id"], ["off"], [LastValue("seen", F.col("usage"))])
    zero = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in USAGE_COLUMNS])
    baselines = (
        seen.where("is_msg")
        .groupBy("session_id", "recipient")
        .agg(F.min_by(F.coalesce("seen", zero), "off").alias("baseline"))
        .withColumnsRenamed({"session_id": "b_session"})
    )
    totals = rows.where("usage is not null").groupBy("session_id").agg(F.max_by("usage", "off").alias("total"))
    joined = ident.join(totals, "session_id", "left").join(
        baselines,
        (F.col("session_id") == F.col("b_session"))
        & F.col("recipient").eqNullSafe(F.col("agent_path"))
        & F.col("is_subagent"),
        "left",
    )
    total = F.coalesce("total", zero)
    subtract = F.coalesce(total["total_tokens"] >= F.col("baseline.total_tokens"), F.lit(False))
    return joined.select(
        *ident.columns,
        *[
            F.when(subtract, F.greatest(total[c] - F.col("baseline")[c], F.lit(0))).otherwise(total[c]).alias(c)
            for c in USAGE_COLUMNS
        ],
    )


def group_rollup(threads_with_usage: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row per root thread: summed usage, number of descendants, summed file sizes."""
    rows = threads_with_usage if sizes is None else threads_with_usage.join(sizes, "session_id", "left")
    aggs = [F.sum(c).cast("bigint").alias(c) for c in USAGE_COLUMNS]
    if sizes is not None:
        aggs.append(F.sum(F.coalesce("file_size", F.lit(0))).cast("bigint").alias("file_size_bytes"))
    return rows.groupBy("root_id").agg(
        *aggs, F.sum((F.col("thread_id") != F.col("root_id")).cast("bigint")).alias("subagent_count")
    )


def group_documents(lines: DataFrame, tree: DataFrame, files: DataFrame) -> DataFrame:
    """One row per root thread with everything its group adds up to; ``files(session_id, path, size, version)`` are the members' file facts.

    ``key`` is the root's file, ``version`` changes with any member's, ``model_contexts`` are the distinct contexts of all members in order of appearance:
    root first, then children by start. Members are folded map-side; contexts are distinct per group before they are put in an array.
    """
    place = F.struct((F.col("thread_id") != F.col("root_id")).alias("is_child"), "started", "thread_id")
    own = own_usage(lines, tree).join(files, "session_id", "left").withColumn("is_root", F.col("thread_id") == F.col("root_id"))
    rolled = own.groupBy("root_id").agg(
        F.min(F.when(F.col("is_root"), F.col("path"))).alias("key"),
        group_version().alias("version"),
        F.sum(F.coalesce("size", F.lit(0))).cast("bigint").alias("file_size_bytes"),
        F.count(F.when(~F.col("is_root"), 1)).alias("subagent_count"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in USAGE_COLUMNS],
    )
    members = tree.select("session_id", "root_id", place.alias("place"))
    turns = model_turns(lines, tree).join(members, "session_id").withColumn("off", F.struct("place", "off"))
    return rolled.join(context_arrays(turns, "root_id"), "root_id", "left")


def model_turns(lines: DataFrame, ident: DataFrame) -> DataFrame:
    """Models named by turn contexts; a file without any falls back to its provider alone."""
    v = F.col("v")
    rows = parsed(lines.where(F.col("line").contains('"turn_context"'))).where("t = 'turn_context'")
    named = rows.groupBy(
        "session_id", V.blank_to_null(V.text(v, "$.payload.model")).alias("model"), V.blank_to_null(effort(v)).alias("thinking_level")
    ).agg(F.min("off").alias("off"))
    provider = V.blank_to_null(F.col("provider"))
    return ident.select("session_id", provider.alias("provider")).join(named, "session_id", "left").select(
        "session_id", F.coalesce("off", F.lit(0).cast("bigint")).alias("off"), "provider", "model", "thinking_level"
    )


def first_prompts(lines: DataFrame) -> DataFrame:
    v = F.col("v")
    text = block_text(v, "$.payload.content")
    rows = parsed(lines.where(F.col("line").contains('"message"'))).where("t = 'response_item' and pt = 'message'")
    rows = rows.where(V.get(v, "$.payload.role") == "user").select("session_id", "off", text.alias("text"))
    kept = rows.where((strings.trim("text") != "") & ~strings.ltrim("text").startswith("<"))
    return kept.groupBy("session_id").agg(F.min_by("text", "off").alias("first_prompt"))


def activity(lines: DataFrame) -> DataFrame:
    """Time of the last message of a file, in file order."""
    rows = parsed(lines).where("t = 'response_item' and pt in ('message', 'agent_message')")
    return rows.groupBy("session_id").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("off"))).alias("updated_at"))


def session_facts(entries_df: DataFrame) -> DataFrame:
    """(session_id, first_prompt, updated_at) of ``entries``: what ``first_prompts`` and ``activity`` say of the lines."""

    def at(known: Column) -> Column:
        return F.when(known, F.col("unit"))

    asked, dated = F.col("asked"), F.col("ts").isNotNull()
    rows = entries_df.where(asked | dated).select("session_id", "unit", "asked", "ts", F.when(asked, F.col("text")).alias("prompt"))
    return rows.groupBy("session_id").agg(F.min_by("prompt", at(asked)).alias("first_prompt"), F.max_by("ts", at(dated)).alias("updated_at"))


def output_text(v: Column) -> Column:
    return V.text_or_json(v, "$.payload.output")


def texts(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    return entries(lines, counts).where("text is not null").select(*TEXT_COLUMNS)


def entries(lines: DataFrame, counts: Observation | None = None) -> DataFrame:
    """(session_id, chunk, unit, seq, ts, asked, kind, text): the texts to be searched, and the messages that ``session_facts`` folds, from one parse.

    ``ts`` is the time of a message, null elsewhere; ``asked`` marks what the user said; a message that is no text to be searched has none. Lines of
    other types are not parsed, unless they are to be counted.
    """
    v, pt, role = F.col("v"), F.col("pt"), F.col("role")
    line = F.col("line")
    gate = line.contains('"response_item"') | line.contains('"agent_reasoning"') | line.contains("\\u")
    rows = V.with_parsed(lines if counts is not None else lines.where(gate), counts=counts)
    place = ["session_id", "chunk", F.col("off").alias("unit"), F.lit(0).alias("seq")]
    t = V.get(v, "$.type")
    # a payload type of another line type stands for nothing here
    rows = rows.select(*place, "v", F.when((t == "response_item") | (t == "event_msg"), F.concat_ws(" ", t, V.get(v, "$.payload.type"))).alias("pt"))
    is_message = pt == "response_item message"
    is_output = pt.isin("response_item function_call_output", "response_item custom_tool_call_output")
    # one step after the other: an expression that is named twice is computed twice
    rows = rows.select(
        *["session_id", "chunk", "unit", "seq", "pt"],
        F.when(is_message | (pt == "response_item agent_message"), V.text(v, "$.timestamp")).alias("at"),
        F.when(is_message, V.get(v, "$.payload.role")).alias("role"),
        F.when(is_message, block_text(v, "$.payload.content")).alias("message"),
        F.when(pt == "response_item function_call", V.parse(V.text(v, "$.payload.arguments"))).alias("arguments"),
        F.when(is_output, output_text(v))
        .when(pt == "response_item custom_tool_call", V.text(v, "$.payload.input"))
        .when(pt == "event_msg agent_reasoning", V.text(v, "$.payload.text"))
        .alias("other"),
    )
    shown = role.isin("user", "assistant") & ~((role == "user") & strings.ltrim("message").startswith("<"))
    text = F.when(is_message, F.when(shown, F.col("message"))).when(pt == "response_item function_call", V.text(F.col("arguments"), "$.command")).otherwise(F.col("other"))
    rows = rows.select("session_id", "chunk", "unit", "seq", "pt", "role", times.local_text(F.col("at")).alias("ts"), text.alias("text"))
    kind = F.when(is_message, "content").when(pt == "event_msg agent_reasoning", "reasoning").otherwise("tool")
    rows = rows.select("session_id", "chunk", "unit", "seq", "ts", "role", kind.alias("kind"), F.when(strings.trim("text") != "", F.col("text")).alias("text"))
    asked = F.coalesce(role == "user", F.lit(False)) & F.col("text").isNotNull()
    some = F.col("text").isNotNull() | F.col("ts").isNotNull()
    return V.expand(rows, ["session_id", "chunk", "unit", "seq"], F.when(some, F.struct("ts", asked.alias("asked"), "kind", "text")))


def group_texts(texts_df: DataFrame, tree: DataFrame) -> DataFrame:
    """Texts of a whole thread group on its root: root first, then the children by start time.

    The order is carried in columns (``member``, ``unit``, ``seq``), so a group is never gathered to number it.
    """
    member = F.struct((F.col("thread_id") != F.col("root_id")).alias("is_child"), "started", "thread_id")
    owners = tree.select("session_id", F.col("root_id").alias("session_key"), member.alias("member"))
    return texts_df.join(owners, "session_id").select("session_key", "member", "unit", "seq", "kind", "text")


def asked_questions(lines: DataFrame) -> DataFrame:
    """(session, call id, question id and text list) of calls that ask the user."""
    v = F.col("v")
    gate = F.lit(False)
    for name in ASK_CALLS:
        gate = gate | F.col("line").contains(name)
    rows = parsed(lines.where(gate)).where("t = 'response_item' and pt = 'function_call'")
    args = V.parse(V.text(v, "$.payload.arguments"))
    asks = rows.where(V.get(v, "$.payload.name").isin(ASK_CALLS)).select(
        "session_id", "off", V.text(v, "$.payload.call_id").alias("call_id"), args.alias("args")
    )
    questions = F.filter(
        F.transform(
            V.array(F.col("args"), "$.questions"),
            lambda q: F.struct(V.get(q, "$.id").alias("id"), F.coalesce(V.get(q, "$.question"), F.lit("")).alias("question")),
        ),
        lambda q: q["id"].isNotNull(),
    )
    return (
        asks.where("call_id is not null and args is not null")
        .withColumn("questions", F.coalesce(questions, F.expr("cast(array() as array<struct<id:string,question:string>>)")))
        .groupBy("session_id", "call_id")
        .agg(F.max_by("questions", "off").alias("questions"))
    )


def answers_json(raw: Column, questions: Column) -> Column:
    """Answers keyed by question id, re-keyed by question text; null when there are none."""
    answers = F.try_variant_get(V.parse(raw), "$.answers", "map<string,variant>")

    def labels(q: Column) -> Column:
        a = F.try_element_at(answers, q["id"])
        plain = F.when(V.array(a, "$").isNotNull(), a)
        return F.struct(q["question"].alias("k"), F.coalesce(V.sub(a, "$.answers"), plain, F.parse_json(F.lit("[]"))).alias("v"))

    given = F.filter(questions, lambda q: F.try_element_at(answers, q["id"]).isNotNull())
    text = F.concat(
        F.lit('{"answers":{'),
        F.array_join(
            F.transform(F.transform(given, labels), lambda e: F.concat(_quoted(e["k"]), F.lit(":"), F.to_json(e["v"]))), ","
        ),
        F.lit("}}"),
    )
    return F.when(F.size(given) > 0, text)


def _quoted(c: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def records(lines: DataFrame, min_level: str = "debug") -> DataFrame:
    """Timeline records; outputs of asking calls carry re-keyed answers."""
    v, t, pt = F.col("v"), F.col("t"), F.col("pt")
    item, event = t == "response_item", t == "event_msg"
    call_id = V.text(v, "$.payload.call_id")
    is_output = item & pt.isin("function_call_output", "custom_tool_call_output")
    # only lines that mention an output can need the join with the questions; the others stay a pure projection
    mentions = F.col("line").contains("_call_output")
    question_type = "array<struct<id:string,question:string>>"
    plain = parsed(lines.where(~mentions)).withColumn("questions", F.lit(None).cast(question_type))
    maybe = parsed(lines.where(mentions)).withColumn(
        # rows without a call id get a key of their own, so they spread instead of meeting in one partition
        "call_key", F.when(is_output & call_id.isNotNull(), call_id).otherwise(F.concat(F.lit("\u0000"), F.col("off").cast("string")))
    )
    asked = asked_questions(lines).withColumnRenamed("call_id", "call_key")
    rows = plain.unionByName(maybe.join(asked, ["session_id", "call_key"], "left").drop("call_key"))

    def rec(record_type, level, content, **extra) -> Column:
        cols = {
            "record_type": F.lit(record_type) if isinstance(record_type, str) else record_type,
            "level": F.lit(level) if isinstance(level, str) else level,
            "content": content,
        }
        for n in ("tool_name", "tool_use_id", "tool_input", "result_meta"):
            cols[n] = extra.get(n, F.lit(None)).cast("string")
        return F.struct(*[c.alias(n) for n, c in cols.items()])

    def s(path: str) -> Column:
        return F.coalesce(V.text(v, f"$.payload.{path}"), F.lit(""))

    def num(path: str) -> Column:
        return V.number(v, f"$.payload.{path}", signed=True).cast("string")

    message = block_text(v, "$.payload.content")
    role = V.get(v, "$.payload.role")
    name = F.coalesce(V.text(v, "$.payload.name"), F.lit("tool"))
    asks = name.isin(ASK_CALLS)
    shell = X.shell_output(output_text(v))
    millis = V.get(v, "$.payload.duration_ms", "bigint")
    first_ms = V.get(v, "$.payload.time_to_first_token_ms", "bigint")
    terminal = F.to_json(
        F.struct(F.struct(shell["exit_code"].alias("exit_code"), shell["duration_ms"].alias("duration_ms")).alias("terminal")),
        {"ignoreNullFields": "false"},
    )
    history = F.coalesce(F.size(V.array(v, "$.payload.replacement_history")), F.lit(0))
    found = (
        F.when(
            t == "session_meta",
            rec("meta", "debug", F.concat(F.lit("session · cwd="), s("cwd"), F.lit(" · provider="), s("model_provider"), F.lit(" · cli "), s("cli_version"))),
        )
        .when(
            t == "compacted",
            rec("meta", "content", F.concat(F.lit("context compacted to "), F.greatest(history, F.lit(0)).cast("string"), F.lit(" entries"))),
        )
        .when(
            t == "turn_context",
            rec(
                "turn",
                "debug",
                F.concat(F.lit("turn · model="), s("model"), F.lit(" · effort="), F.coalesce(effort(v), F.lit("")), F.lit(" · "), s("sandbox_policy.type")),
            ),
        )
        .when(
            event & (pt == "token_count"),
            rec(
                "usage",
                "debug",
                F.concat(
                    F.lit("tokens · input "), num("info.last_token_usage.input_tokens"),
                    F.lit(" (cached "), num("info.last_token_usage.cached_input_tokens"),
                    F.lit(") · output "), num("info.last_token_usage.output_tokens"),
                    F.lit(" (reasoning "), num("info.last_token_usage.reasoning_output_tokens"),
                    F.lit(") · total "), num("info.total_token_usage.total_tokens"),
                    F.lit("/"), num("info.model_context_window"),
                ),
            ),
        )
        .when(event & (pt == "error"), rec("meta", "debug", F.concat(F.lit("error: "), s("message"))))
        .when(
            event & (pt == "agent_reasoning"),
            F.when(strings.trim(s("text")) != "", rec("thinking", "content", s("text"))),
        )
        .when(
            event & (pt == "turn_aborted"),
            rec("meta", "content", F.concat(F.lit("turn aborted: "), F.coalesce(V.text(v, "$.payload.reason"), F.lit("aborted")))),
        )
        .when(event & (pt == "thread_rolled_back"), rec("meta", "content", F.concat(F.lit("rolled back "), num("num_turns"), F.lit(" turns"))))
        .when(event & (pt == "task_started"), rec("meta", "debug", F.lit("turn started")))
        .when(
            event & (pt == "task_complete"),
            rec(
                "meta",
                "debug",
                F.concat(
                    F.lit("turn finished"),
                    F.when(millis.isNotNull(), F.format_string(" · %.1fs", millis / F.lit(1000.0))).otherwise(""),
                    F.when(first_ms.isNotNull(), F.concat(F.lit(" · first token "), first_ms.cast("string"), F.lit("ms"))).otherwise(""),
                ),
            ),
        )
        .when(
            item & (pt == "message"),
            F.when(role == "assistant", rec("assistant", "content", message))
            .when(role == "developer", rec("meta", "debug", F.concat(F.lit("developer: "), message)))
            .when((role == "user") & strings.ltrim(message).startswith("<"), rec("meta", "debug", message))
            .when(role == "user", rec("user", "content", message)),
        )
        .when(
            item & (pt == "function_call"),
            rec(
                "assistant",
                F.when(asks, "content").otherwise("tool"),
                F.lit(""),
                tool_name=F.when(asks, "ask_user_question").otherwise(name),
                tool_use_id=call_id,
                tool_input=V.as_json(V.parse(V.text(v, "$.payload.arguments"))),
            ),
        )
        .when(
            item & (pt == "custom_tool_call"),
            rec("assistant", "tool", F.lit(""), tool_name=name, tool_use_id=call_id, tool_input=F.to_json(F.struct(s("input").alias("input")))),
        )
        .when(
            item & (pt == "web_search_call"),
            rec("assistant", "tool", F.lit(""), tool_name=F.lit("web_search"), tool_use_id=call_id, tool_input=V.as_json(V.sub(v, "$.payload.action"))),
        )
        .when(
            is_output & F.col("questions").isNotNull(),
            rec("tool_result", "content", F.lit(""), tool_use_id=call_id, result_meta=answers_json(output_text(v), F.col("questions"))),
        )
        .when(
            is_output,
            rec("tool_result", "tool", shell["body"], tool_use_id=call_id, result_meta=F.when(shell["lifted"], terminal)),
        )
    )
    return (
        V.expand(
            rows,
            [
                "session_id", "chunk", F.col("off").alias("unit"), "ts", F.lit(0).alias("seq"),
                F.lit(None).cast("string").alias("group_id"), F.lit(None).cast("string").alias("diff"),
            ],
            found,
        )
        .where(visible(F.col("level"), min_level))
        .select(*RECORD_COLUMNS)
    )


def subagent_links(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """(root, child thread, call id, arguments): which call opened a sub-agent.

    A started event or a spawn output names the child; the first one wins, root file first, then by start
    time. Otherwise the agent path must end with the task name of a spawn call: the path is exploded into
    its suffixes, which turns the suffix test into an equi join inside the group.
    """
    v, t, pt = F.col("v"), F.col("t"), F.col("pt")
    member = tree.select(
        "session_id",
        "thread_id",
        "root_id",
        F.struct((F.col("thread_id") != F.col("root_id")).alias("is_child"), "started", F.col("thread_id").alias("tid")).alias("rank"),
    )
    children = tree.where("thread_id <> root_id")
    parents = children.select("root_id", F.col("parent_id").alias("thread_id")).unionByName(
        tree.where("thread_id = root_id").select("root_id", "thread_id")
    )
    scanned = member.join(parents.distinct(), ["root_id", "thread_id"], "left_semi").drop("thread_id")
    gate = F.col("line").contains('"spawn_agent"') | F.col("line").contains('"sub_agent_activity"') | F.col("line").contains("agent_id")
    call_id = V.text(v, "$.payload.call_id")
    item = t == "response_item"
    raw = V.text(v, "$.payload.output")
    output = F.coalesce(V.parse(raw), F.when(raw.isNull(), V.sub(v, "$.payload.output")))

    def fact(role: str, call: Column, child: Column, args: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), call.alias("call_id"), child.alias("child"), args.alias("args"))

    none = F.lit(None).cast("string")
    found = (
        F.when(
            item & (pt == "function_call") & (V.get(v, "$.payload.name") == "spawn_agent"),
            fact("spawn", call_id, none, V.as_json(V.parse(V.text(v, "$.payload.arguments")))),
        )
        .when(item & (pt == "function_call_output"), fact("answer", call_id, V.text(output, "$.agent_id"), none))
        .when(
            (t == "event_msg") & (pt == "sub_agent_activity") & (V.get(v, "$.payload.kind") == "started"),
            fact("start", V.text(v, "$.payload.event_id"), V.text(v, "$.payload.agent_thread_id"), none),
        )
    )
    # the few facts of the gated lines are written once; every step below reads them
    facts = V.expand(parsed(lines.where(gate)), ["session_id", "off"], found).where("call_id is not null")
    facts = cut_lineage(facts.join(scanned, "session_id").select("root_id", F.struct("rank", "off").alias("at"), "role", "call_id", "child", "args"), "spawn-facts")
    spawns = facts.where("role = 'spawn'").groupBy("root_id", "call_id").agg(F.min("at").alias("at"), F.min_by("args", "at").alias("args"))
    started = facts.where("role = 'start'").select("root_id", "at", "child", "call_id")
    earlier = spawns.select("root_id", "call_id", F.col("at").alias("spawned"))
    answered = facts.where("role = 'answer' and child is not null").select("root_id", "at", "child", "call_id")
    answered = answered.join(earlier, ["root_id", "call_id"]).where("spawned < at").drop("spawned")
    named = (
        started.unionByName(answered)
        .where("child is not null")
        .groupBy("root_id", F.col("child").alias("thread_id"))
        .agg(F.min_by("call_id", "at").alias("named_call"))
    )
    linked = children.select("root_id", "thread_id", "agent_path", "agent_role").join(named, ["root_id", "thread_id"], "left")

    parts = F.split("agent_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tasks = (
        spawns.select("root_id", F.get_json_object("args", "$.task_name").alias("task"), "call_id", "at")
        .where("task is not null")
        .groupBy("root_id", "task")
        .agg(F.min(F.struct("at", "call_id")).alias("first"))
    )
    by_path = (
        linked.where("named_call is null and agent_path is not null")
        .select("root_id", "thread_id", F.explode(suffixes).alias("task"))
        .join(tasks, ["root_id", "task"])
        .groupBy("root_id", "thread_id")
        .agg(F.min("first").alias("first"))
        .select("root_id", "thread_id", F.col("first.call_id").alias("path_call"))
    )
    return (
        linked.join(by_path, ["root_id", "thread_id"], "left")
        .withColumn("call_id", F.coalesce("named_call", "path_call"))
        .join(spawns.select("root_id", "call_id", "args"), ["root_id", "call_id"], "left")
        .select("root_id", "thread_id", "call_id", "args")
    )


def child_timeline(records_df: DataFrame, tree: DataFrame, *folded: Column) -> DataFrame:
    """Sub-agent records readable under their resolved root, at tool level; ``folded`` aggregates give one row per file instead, folded before the join."""
    scope = tree.where("is_subagent and thread_id <> root_id").select("session_id", "root_id", "thread_id")
    shown = records_df.where("level <> 'debug'")
    return (shown.groupBy("session_id").agg(*folded) if folded else shown).join(scope, "session_id")


def search_hits(lines: DataFrame, query: str) -> DataFrame:
    q = query.lower()
    v, t, pt = F.col("v"), F.col("t"), F.col("pt")
    rows = parsed(lines.where(X.may_hold(F.col("line"), q)))
    item = t == "response_item"

    def hit(label, text: Column) -> Column:
        return F.struct((F.lit(label) if isinstance(label, str) else label).alias("record_type"), F.coalesce(text, F.lit("")).alias("text"))

    found = (
        F.when(item & (pt == "message"), hit(F.coalesce(V.get(v, "$.payload.role"), F.lit("message")), block_text(v, "$.payload.content")))
        .when(item & (pt == "function_call"), hit("tool", V.text(v, "$.payload.arguments")))
        .when(item & (pt == "custom_tool_call"), hit("tool", V.text(v, "$.payload.input")))
        .when(item & pt.isin("function_call_output", "custom_tool_call_output"), hit("tool_result", output_text(v)))
        .when((t == "event_msg") & (pt == "agent_reasoning"), hit("thinking", V.text(v, "$.payload.text")))
    )
    return (
        V.expand(rows, ["session_id", F.col("off").alias("unit"), "ts"], found)
        .where(F.contains(F.lower("text"), F.lit(q)))
        .select("session_id", "unit", "record_type", snippet(F.col("text"), q).alias("snippet"), "ts")
    )


# --- side tables -------------------------------------------------------------------------------------


def with_thread_info(sessions: DataFrame, info: DataFrame, memories: DataFrame) -> DataFrame:
    """Side-table titles and times override the log's; a memory title is the second choice.

    ``info(thread_id, title, created_at, updated_at)`` holds epoch numbers in seconds or milliseconds.
    """
    clean = info.select(
        "thread_id",
        X.readable_title(F.col("title")).alias("info_title"),
        times.epoch_text(F.col("created_at")).alias("info_created"),
        times.epoch_text(F.col("updated_at")).alias("info_updated"),
    )
    titles = memories.select(
        "thread_id", X.fallback_title(F.col("thread_id"), F.col("rollout_summary"), F.col("raw_memory")).alias("memory_title")
    )
    return (
        sessions.join(clean, "thread_id", "left")
        .join(titles, "thread_id", "left")
        .select(
            *[c for c in sessions.columns if c not in ("created_at", "updated_at")],
            F.coalesce("info_title", "memory_title").alias("agent_title"),
            F.coalesce("info_created", "created_at").alias("created_at"),
            F.coalesce("info_updated", "updated_at").alias("updated_at"),
        )
    )


def memories(outputs: DataFrame, info: DataFrame) -> DataFrame:
    """Thread memories as files, most recently used first when ordered by ``recency``."""
    titles = info.select("thread_id", X.readable_title(F.col("title")).alias("title"))
    summary = F.col("rollout_summary")
    body = F.when(strings.trim(summary) == "", F.col("raw_memory")).otherwise(F.concat("raw_memory", F.lit("\n\n---\n\n"), summary))
    uses = F.when(F.col("usage_count").isNotNull(), F.concat(F.lit("used "), F.col("usage_count").cast("string"), F.lit(" times · "))).otherwise("")
    return outputs.join(titles, "thread_id", "left").select(
        F.concat("thread_id", F.lit(".md")).alias("filename"),
        F.coalesce("title", X.fallback_title(F.col("thread_id"), summary, F.col("raw_memory"))).alias("name"),
        F.concat(uses, F.lit("session "), F.left("thread_id", F.lit(8))).alias("description"),
        F.lit("thread").alias("memory_type"),
        body.alias("content"),
        F.octet_length(body).cast("bigint").alias("size_bytes"),
        F.coalesce("last_usage", "generated_at").alias("recency"),
    )
