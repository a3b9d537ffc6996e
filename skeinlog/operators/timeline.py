"""Timeline operators over records: pairing, hooks, parallel batches, paging and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.functions.text import TERMINAL_MARKS, strip_terminal
from skeinlog.operators.ordered import LastValue, RunningSum, ordered_scan

# fixed values: calls that open a sub-agent, and the interactive question call
AGENT_CALLS = ["Agent", "spawn_agent"]
QUESTION_CALL = "AskUserQuestion"

def unit_order() -> Column:
    return F.struct("unit", "seq")


def pair_calls(records: DataFrame) -> DataFrame:
    """Every call with its result: the last record per id wins on both sides.

    Both sides are folded to one row per (session, id) before the join, with map-side combine, so a
    repeated id never multiplies rows or gathers in one task.
    """
    named = records.where("tool_use_id is not null")
    calls = (
        named.where(F.coalesce(F.col("tool_name"), F.lit("")) != "")
        .groupBy("session_id", "tool_use_id")
        .agg(F.max_by(F.struct("unit", "tool_name", "tool_input", "ts", "group_id"), unit_order()).alias("c"))
    )
    results = (
        named.where("record_type = 'tool_result'")
        .groupBy("session_id", "tool_use_id")
        .agg(F.max_by(F.struct("unit", "content", "ts", "result_meta", "diff"), unit_order()).alias("r"))
    )
    return calls.join(results, ["session_id", "tool_use_id"], "left").select(
        "session_id",
        "tool_use_id",
        F.col("c.unit").alias("call_unit"),
        F.col("c.tool_name").alias("tool_name"),
        F.col("c.tool_input").alias("tool_input"),
        F.col("c.ts").alias("call_ts"),
        F.col("c.group_id").alias("group_id"),
        F.col("r.unit").alias("result_unit"),
        F.col("r.content").alias("result"),
        F.col("r.result_meta").alias("result_meta"),
        F.col("r.diff").alias("diff"),
    )


def hooks(records: DataFrame) -> DataFrame:
    """Hook records of a call, Pre and Post apart; the first record per (call, label, phase) is kept."""
    phase = F.when(F.col("content").startswith("🪝 Pre"), "pre").when(F.col("content").startswith("🪝 Post"), "post")
    rows = records.where("record_type = 'hook' and tool_use_id is not null").select(
        "session_id", "tool_use_id", "unit", "seq", phase.alias("phase"), F.substring_index("content", "\n", 1).alias("label"), "content"
    )
    return (
        rows.where("phase is not null")
        .groupBy("session_id", "tool_use_id", "phase", "label")
        .agg(F.min("unit").alias("unit"), F.min_by("content", unit_order()).alias("content"))
    )


def calls_with_hooks(records: DataFrame) -> DataFrame:
    """Calls left-joined with how many distinct hooks ran before and after them."""
    counted = (
        hooks(records)
        .groupBy("session_id", "tool_use_id")
        .agg(
            F.count(F.when(F.col("phase") == "pre", 1)).alias("pre_hooks"),
            F.count(F.when(F.col("phase") == "post", 1)).alias("post_hooks"),
        )
    )
    zero = F.lit(0).cast("bigint")
    return pair_calls(records).join(counted, ["session_id", "tool_use_id"], "left").withColumns(
        {"pre_hooks": F.coalesce("pre_hooks", zero), "post_hooks": F.coalesce("post_hooks", zero)}
    )


def call_hook_rows(records: DataFrame) -> DataFrame:
    """Every hook of every call, as it stands on the call's card: those before the result, then those after it.

    ``phase`` is pre or post and ``nth`` its place in the phase, from 1; a hook that repeats a label of its call and phase is left out. The places are a
    two-level running sum over slices of the session, so a call with any number of hooks is not ordered in one task.
    """
    phase = F.when(F.col("content").startswith("🪝 Pre"), "pre").when(F.col("content").startswith("🪝 Post"), "post")
    rows = records.where("record_type = 'hook' and tool_use_id is not null").select(
        "session_id", "tool_use_id", phase.alias("phase"), F.substring_index("content", "\n", 1).alias("label"), F.struct("unit", "seq", "chunk", "content", "ts").alias("h")
    )
    firsts = rows.where("phase is not null").groupBy("session_id", "tool_use_id", "phase", "label").agg(F.min_by("h", F.struct("h.unit", "h.seq")).alias("h"))
    firsts = firsts.select("session_id", "tool_use_id", "phase", "label", "h.*")
    placed = ordered_scan(firsts, ["session_id", "tool_use_id", "phase"], ["unit", "seq"], [RunningSum("nth", F.lit(1).cast("bigint"))])
    calls = pair_calls(records).select("session_id", "tool_use_id", "tool_name", "call_unit", "result_unit")
    return calls.join(placed, ["session_id", "tool_use_id"]).select(
        "session_id", "tool_use_id", "tool_name", "call_unit", "result_unit", "phase", "nth", "label", F.col("unit").alias("hook_unit"), "content", "ts"
    )


def parallel_batches(records: DataFrame) -> DataFrame:
    """Runs of consecutive eligible calls of one model turn, longer than one."""
    name = F.coalesce(F.col("tool_name"), F.lit(""))
    eligible = F.coalesce(
        (name != "")
        & (F.col("record_type") == "assistant")
        & ~name.isin(*AGENT_CALLS, QUESTION_CALL)
        & (F.coalesce(F.col("group_id"), F.lit("")) != ""),
        F.lit(False),
    )
    marked = records.select(
        "session_id", "chunk", "unit", "seq", F.when(eligible, F.col("group_id")).alias("g"), "tool_use_id"
    ).withColumn("mark", F.struct(F.col("g")))
    order = ["unit", "seq"]
    with_prev = ordered_scan(marked, ["session_id"], order, [LastValue("prev", F.col("mark"), inclusive=False)])
    starts = with_prev.withColumn("starts", (~F.col("prev.g").eqNullSafe(F.col("g"))).cast("bigint"))
    islands = ordered_scan(starts, ["session_id"], order, [RunningSum("island", F.col("starts"))])
    return (
        islands.where("g is not null")
        .groupBy("session_id", "island")
        .agg(F.min("unit").alias("first_unit"), F.first("g").alias("group_id"), F.count("*").alias("width"))
        .where("width > 1")
        .drop("island")
    )


def without_terminal_formatting(records: DataFrame) -> DataFrame:
    """Records as a reader gets them: terminal controls are taken out of tool results and of the stderr beside them.

    Other texts may quote such controls and stay as they are.
    """
    content, meta = F.col("content"), F.col("result_meta")
    clean = F.when((F.col("record_type") == "tool_result") & content.rlike(TERMINAL_MARKS), strip_terminal(content)).otherwise(content)
    stderr = F.get_json_object(meta, "$.terminal.stderr")

    def quoted(text: Column) -> Column:
        wrapped = F.to_json(F.array(text))
        return F.concat(F.lit('"stderr":'), F.substring(wrapped, F.lit(2), F.length(wrapped) - 2))

    cleaned = F.when(stderr.rlike(TERMINAL_MARKS), F.replace(meta, quoted(stderr), quoted(strip_terminal(stderr)))).otherwise(meta)
    return records.withColumns({"content": clean, "result_meta": cleaned})


# --- pages -----------------------------------------------------------------------------------------


def _units(records: DataFrame) -> DataFrame:
    return records.groupBy("session_id", "chunk", "unit").agg(F.count("*").alias("n"))


def _whole_units(units: DataFrame, limit: int, ascending: bool) -> DataFrame:
    """Units of a page: taken whole, one after another, until at least ``limit`` records are in.

    Two levels: the records of every chunk are counted, and sums over the chunks of a session tell which of them the page reaches.
    Only there are units ranked, inside their chunk, so a page of any size never orders a session in one task.
    """
    order = (lambda c: F.col(c).asc()) if ascending else (lambda c: F.col(c).desc())
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    chunks = units.groupBy("session_id", "chunk").agg(F.sum("n").alias("in_chunk"))
    chunks = chunks.withColumn("ahead", F.coalesce(F.sum("in_chunk").over(before("session_id").orderBy(order("chunk"))), zero))
    reached = units.join(chunks.where(F.col("ahead") < limit).select("session_id", "chunk", "ahead"), ["session_id", "chunk"])
    inside = F.coalesce(F.sum("n").over(before("session_id", "chunk").orderBy(order("unit"))), zero)
    return reached.withColumn("taken", F.col("ahead") + inside).where(F.col("taken") < limit).select("session_id", "chunk", "unit")


def _page(records: DataFrame, chosen: DataFrame) -> DataFrame:
    return records.join(chosen, ["session_id", "chunk", "unit"], "left_semi")


def forward_page(records: DataFrame, limit: int, cursor: int = 0) -> DataFrame:
    """First page at or after ``cursor``, for every session at once."""
    return _page(records, _whole_units(_units(records.where(F.col("unit") >= cursor)), limit, True))


def backward_page(records: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """Last page before an exclusive cursor; without a cursor the tail of every session."""
    scope = records if before is None else records.where(F.col("unit") < before)
    return _page(records, _whole_units(_units(scope), limit, False))


def page_info(records: DataFrame, page: DataFrame) -> DataFrame:
    """Cursor columns of a page: its first unit, the unit that follows it, and what lies around it."""
    span = records.groupBy("session_id").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    bounds = page.groupBy("session_id").agg(
        F.min("unit").alias("start_unit"), F.max("unit").alias("last_unit"), F.count("*").alias("page_records")
    )
    return bounds.join(span, "session_id").select(
        "session_id",
        "start_unit",
        "last_unit",
        "page_records",
        (F.col("start_unit") > F.col("lo")).cast("int").alias("has_earlier"),
        (F.col("last_unit") < F.col("hi")).cast("int").alias("has_more"),
    )


def align_cursor(lines: DataFrame, cursor: Column) -> DataFrame:
    """Next unit boundary at or after a cursor and last boundary at or before it, per session."""
    at = F.col("off")
    return lines.groupBy("session_id").agg(
        F.min(F.when(at >= cursor, at)).alias("next_unit"), F.max(F.when(at <= cursor, at)).alias("prev_unit")
    )


def visible_counts(records: DataFrame) -> DataFrame:
    """How many records of a session each view shows."""
    return records.groupBy("session_id").agg(
        F.count(F.when(F.col("level") == "content", 1)).alias("content_view"),
        F.count(F.when(F.col("level") != "debug", 1)).alias("tool_view"),
        F.count("*").alias("debug_view"),
    )


def tool_profile(pairs: DataFrame) -> DataFrame:
    """Per tool: calls, answered calls, error rate, total duration and files touched."""
    meta = F.try_parse_json("result_meta")
    exit_code = F.try_variant_get(meta, "$.terminal.exit_code", "bigint")
    failed = F.coalesce(exit_code != 0, F.try_variant_get(meta, "$.is_error", "boolean"), F.lit(False))
    millis = F.coalesce(
        F.try_variant_get(meta, "$.terminal.duration_ms", "bigint"), F.try_variant_get(meta, "$.webfetch.duration_ms", "bigint")
    )
    return pairs.groupBy("tool_name").agg(
        F.count("*").alias("calls"),
        F.count("result_unit").alias("answered"),
        F.sum(failed.cast("bigint")).alias("errors"),
        F.coalesce(F.sum(millis), F.lit(0)).cast("bigint").alias("duration_ms"),
        F.count(F.get_json_object("tool_input", "$.file_path")).alias("file_calls"),
    )
