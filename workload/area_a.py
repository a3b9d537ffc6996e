"""Dialect A: records, pairing, paging, session summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators import models
from skeinlog.operators import timeline as T
from skeinlog.schemas import USAGE_COLUMNS
from skeinlog.session import cut_lineage
from skeinlog.sources import dialect_a as A
from workload import fixture_a, fixture_h
from workload.registry import Area
from workload.tables import table

area = Area()

# Base rows of the dialect A lines, straight from the table.
BASE = """
WITH b AS (
  SELECT conv_id, turn, role, text, length(text) AS n, 'c' || conv_id AS session_id,
         strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS ts,
         'call-' || conv_id || '-' || turn AS call_id,
         role = 'assistant' AND turn % 2 = 0 AS plain,
         role = 'assistant' AND turn % 4 = 1 AS chunked,
         role = 'assistant' AND turn % 4 = 3 AS tool,
         conv_id % 6 = 2 AND turn < 2 AND role = 'user' AS noisy
  FROM conversations)
"""

RECORDS = BASE + """
, r AS (
  SELECT session_id, turn*10 AS unit, 0 AS seq, 'user' AS record_type,
         CASE WHEN noisy AND conv_id % 2 = 0 THEN 'debug' ELSE 'content' END AS level,
         CASE WHEN noisy AND conv_id % 2 = 0 THEN '<local-command>' || text ELSE text END AS content, ts,
         NULL AS tool_name, NULL AS tool_use_id, NULL AS group_id FROM b WHERE role = 'user'
  UNION ALL SELECT session_id, turn*10, 0, 'system', 'content', text, ts, NULL, NULL, NULL FROM b WHERE role = 'system'
  UNION ALL SELECT session_id, turn*10, 0, 'thinking', 'content', left(text, 30), ts, NULL, NULL, 'm-' || conv_id || '-' || turn
            FROM b WHERE plain AND n % 3 = 0
  UNION ALL SELECT session_id, turn*10, 1, 'assistant', 'content', text, ts, NULL, NULL, 'm-' || conv_id || '-' || turn FROM b WHERE plain
  UNION ALL SELECT session_id, turn*10+1, 1, 'assistant', 'content', text, ts, NULL, NULL, 'm-' || conv_id || '-' || turn
            FROM b WHERE chunked OR tool
  UNION ALL SELECT session_id, turn*10+1, 2, 'assistant', 'tool', '', ts, 'Bash', call_id, 'm-' || conv_id || '-' || turn FROM b WHERE tool
  UNION ALL SELECT session_id, turn*10+2, 2, 'assistant', 'tool', '', ts, 'Read', call_id || '-b', 'm-' || conv_id || '-' || turn
            FROM b WHERE tool AND conv_id % 3 = 0
  UNION ALL SELECT session_id, turn*10+3, 0, 'tool_result', 'tool', text, ts, NULL, call_id, NULL FROM b WHERE tool AND conv_id % 5 <> 0
  UNION ALL SELECT session_id, turn*10+k, 0, 'hook', 'debug', '🪝 PreToolUse:Bash', ts, NULL, call_id, NULL
            FROM b, (VALUES (4), (5)) h(k) WHERE tool
  UNION ALL SELECT session_id, turn*10+7, 0, 'summary', 'debug', '', NULL, NULL, NULL, NULL FROM b WHERE turn = 0 AND conv_id % 7 IN (0, 3)
  UNION ALL SELECT session_id, turn*10+9, 0, 'custom-title', 'debug', '', NULL, NULL, NULL, NULL FROM b WHERE turn = 0 AND conv_id % 7 = 0
)
"""
RECORD_LIST = "session_id, unit, seq, record_type, level, content, ts, tool_name, tool_use_id, group_id"


def records(spark: SparkSession, sf_dir: str, min_level: str = "debug") -> DataFrame:
    return A.records(fixture_a.lines(spark, sf_dir), min_level)


def record_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as a written table, for operators that read them more than once."""
    return cut_lineage(records(spark, sf_dir), "records")


@area.query("message_records", RECORDS + f"SELECT {RECORD_LIST} FROM r")
def message_records(spark, sf_dir):
    return records(spark, sf_dir).select(*RECORD_LIST.split(", "))


@area.query(
    "message_records_content_view",
    RECORDS + f"SELECT {RECORD_LIST} FROM r WHERE level = 'content' ",
)
def message_records_content(spark, sf_dir):
    return records(spark, sf_dir, "content").select(*RECORD_LIST.split(", "))


@area.query(
    "content_view_equals_filter",
    RECORDS + "SELECT session_id, count(*) AS viewed, count(*) AS filtered FROM r WHERE level = 'content' GROUP BY 1",
)
def content_view_equals_filter(spark, sf_dir):
    """Rows of the content view, and those of them that the filtered tool view has as well."""
    names = RECORD_LIST.split(", ")
    view = records(spark, sf_dir, "content").select(*names)
    tools = records(spark, sf_dir, "tool").where("level = 'content'").select(*names)
    both = view.intersectAll(tools).groupBy("session_id").agg(F.count("*").alias("filtered"))
    return view.groupBy("session_id").agg(F.count("*").alias("viewed")).join(both, "session_id", "left")


@area.query(
    "visibility_counts",
    RECORDS
    + """SELECT session_id, count(*) FILTER (level = 'content') AS content_view,
    count(*) FILTER (level <> 'debug') AS tool_view, count(*) AS debug_view FROM r GROUP BY 1""",
)
def visibility_counts(spark, sf_dir):
    return T.visible_counts(records(spark, sf_dir))


@area.query(
    "tool_call_pairs",
    BASE
    + """, c AS (
      SELECT session_id, call_id AS tool_use_id, turn*10+1 AS call_unit, 'Bash' AS tool_name, 'm-' || conv_id || '-' || turn AS group_id,
             CASE WHEN conv_id % 5 <> 0 THEN turn*10+3 END AS result_unit, CASE WHEN conv_id % 5 <> 0 THEN text END AS result
      FROM b WHERE tool
      UNION ALL SELECT session_id, call_id || '-b', turn*10+2, 'Read', 'm-' || conv_id || '-' || turn, NULL, NULL
      FROM b WHERE tool AND conv_id % 3 = 0)
    SELECT * FROM c""",
)
def tool_call_pairs(spark, sf_dir):
    return T.pair_calls(record_table(spark, sf_dir)).select(
        "session_id", "tool_use_id", "call_unit", "tool_name", "group_id", "result_unit", "result"
    )


@area.query(
    "hook_call_pairs",
    BASE
    + """SELECT session_id, call_id AS tool_use_id, 'Bash' AS tool_name, 1 AS pre_hooks, 0 AS post_hooks FROM b WHERE tool
      UNION ALL SELECT session_id, call_id || '-b', 'Read', 0, 0 FROM b WHERE tool AND conv_id % 3 = 0""",
)
def hook_call_pairs(spark, sf_dir):
    return T.calls_with_hooks(record_table(spark, sf_dir)).select(
        "session_id", "tool_use_id", "tool_name", "pre_hooks", "post_hooks"
    )


@area.query(
    "call_hook_rows",
    fixture_h.CALLS_SQL
    + "SELECT session_id, call_id AS tool_use_id, tool_name, call_unit, result_unit, phase, nth, label, hook_unit, label || chr(10) || body AS content FROM h",
)
def call_hook_rows(spark, sf_dir):
    """Hooks before and after the result of every call, of varying number; one of them is said twice."""
    recs = cut_lineage(A.records(fixture_h.lines(spark, sf_dir)), "records")
    return T.call_hook_rows(recs).drop("ts")


@area.query(
    "hook_counts_of_calls",
    fixture_h.CALLS_SQL
    + """SELECT b.session_id, b.call_id AS tool_use_id, b.tool_name, count(*) FILTER (phase = 'pre') AS pre_hooks, count(*) FILTER (phase = 'post') AS post_hooks
    FROM b LEFT JOIN h ON h.call_id = b.call_id GROUP BY 1, 2, 3""",
)
def hook_counts_of_calls(spark, sf_dir):
    recs = cut_lineage(A.records(fixture_h.lines(spark, sf_dir)), "records")
    return T.calls_with_hooks(recs).select("session_id", "tool_use_id", "tool_name", "pre_hooks", "post_hooks")


@area.query(
    "parallel_batches_of_any_width",
    fixture_h.CALLS_SQL
    + "SELECT session_id, turn * 100 AS first_unit, 'm-' || conv_id || '-' || turn AS group_id, any_value(width) AS width FROM b WHERE width > 1 GROUP BY session_id, conv_id, turn",
)
def parallel_batches_of_any_width(spark, sf_dir):
    return T.parallel_batches(cut_lineage(A.records(fixture_h.lines(spark, sf_dir)), "records"))


@area.query(
    "tool_durations",
    fixture_h.CALLS_SQL
    + """SELECT tool_name, count(*) AS calls, count(result_unit) AS answered, 0::BIGINT AS errors,
    coalesce(sum(n * 3 + j) FILTER (j % 2 = 1 AND result_unit IS NOT NULL), 0)::BIGINT AS duration_ms, 0::BIGINT AS file_calls FROM b GROUP BY 1""",
)
def tool_durations(spark, sf_dir):
    return T.tool_profile(T.pair_calls(cut_lineage(A.records(fixture_h.lines(spark, sf_dir)), "records")))


@area.query(
    "parallel_batches",
    BASE
    + """SELECT session_id, turn*10+1 AS first_unit, 'm-' || conv_id || '-' || turn AS group_id, 2 AS width
      FROM b WHERE tool AND conv_id % 3 = 0""",
)
def parallel_batches(spark, sf_dir):
    return T.parallel_batches(record_table(spark, sf_dir))


@area.query(
    "parallel_width_distribution",
    BASE + "SELECT 2 AS width, count(*) AS batches FROM b WHERE tool AND conv_id % 3 = 0 HAVING count(*) > 0",
)
def parallel_width_distribution(spark, sf_dir):
    return T.parallel_batches(record_table(spark, sf_dir)).groupBy("width").agg(F.count("*").alias("batches"))


PAGE = """, u AS (SELECT session_id, unit, count(*) AS n FROM r WHERE {scope} GROUP BY 1, 2),
t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY session_id ORDER BY unit {dir} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM u),
p AS (SELECT r.* FROM r JOIN (SELECT session_id, unit FROM t WHERE taken < {limit}) k USING (session_id, unit)),
s AS (SELECT session_id, min(unit) AS lo, max(unit) AS hi FROM r GROUP BY 1)
SELECT session_id, min(unit) AS start_unit, max(unit) AS last_unit, count(*) AS page_records,
       (min(unit) > any_value(lo))::INT AS has_earlier, (max(unit) < any_value(hi))::INT AS has_more
FROM p JOIN s USING (session_id) GROUP BY session_id"""


def _paged(spark, sf_dir, take):
    recs = record_table(spark, sf_dir)
    return T.page_info(recs, take(recs))


@area.query("page_forward", RECORDS + PAGE.format(scope="unit >= 10", dir="", limit=5))
def page_forward(spark, sf_dir):
    return _paged(spark, sf_dir, lambda r: T.forward_page(r, 5, 10))


@area.query("page_tail", RECORDS + PAGE.format(scope="true", dir="DESC", limit=4))
def page_tail(spark, sf_dir):
    return _paged(spark, sf_dir, lambda r: T.backward_page(r, 4))


@area.query("page_before", RECORDS + PAGE.format(scope="unit < 30", dir="DESC", limit=3))
def page_before(spark, sf_dir):
    return _paged(spark, sf_dir, lambda r: T.backward_page(r, 3, 30))


@area.query(
    "page_tail_records",
    RECORDS + PAGE.split("s AS (")[0].rstrip().rstrip(",").format(scope="true", dir="DESC", limit=4)
    + f" SELECT {RECORD_LIST} FROM p",
)
def page_tail_records(spark, sf_dir):
    return T.backward_page(record_table(spark, sf_dir), 4).select(*RECORD_LIST.split(", "))


HOT_RECORDS = """WITH r AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 's' || (event_id % 41) END AS session_id, event_id // 5 AS unit, event_id % 5 AS seq FROM events)
"""


def hot_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which one session holds a third, in chunks of 100 units."""
    e = F.col("event_id")
    session = F.when(e % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (e % 41).cast("string")))
    unit = F.floor(e / 5).cast("bigint")
    return table(spark, sf_dir, "events").select(session.alias("session_id"), F.floor(unit / 100).cast("bigint").alias("chunk"), unit.alias("unit"), (e % 5).alias("seq"))


@area.query("page_of_a_hot_session", HOT_RECORDS + PAGE.format(scope="true", dir="DESC", limit=2500))
def page_of_a_hot_session(spark, sf_dir):
    recs = hot_records(spark, sf_dir)
    return T.page_info(recs, T.backward_page(recs, 2500))


@area.query(
    "turn_text_pieces",
    BASE
    + """SELECT session_id, turn*10 AS off, text FROM b WHERE plain
    UNION ALL SELECT session_id, turn*10, left(text, 10) FROM b WHERE chunked AND n >= 8
    UNION ALL SELECT session_id, turn*10 + 1, CASE WHEN n >= 8 THEN substr(text, 11) ELSE text END FROM b WHERE chunked
    UNION ALL SELECT session_id, turn*10, text FROM b WHERE tool AND n >= 8
    UNION ALL SELECT session_id, turn*10 + 1, CASE WHEN n >= 8 THEN '' ELSE text END FROM b WHERE tool
    UNION ALL SELECT session_id, turn*10 + 2, '' FROM b WHERE tool AND conv_id % 3 = 0""",
)
def turn_text_pieces(spark, sf_dir):
    """Merged texts that stay in pieces beyond 8 characters."""
    return A.merge_turns(A.turn_rows(fixture_a.lines(spark, sf_dir)), 8).select("session_id", "off", "text")


LINE_OFFSETS = """, l AS (
  SELECT session_id, turn*10 AS off FROM b UNION ALL SELECT session_id, turn*10+1 FROM b WHERE chunked OR tool
  UNION ALL SELECT session_id, turn*10+2 FROM b WHERE tool AND conv_id % 3 = 0
  UNION ALL SELECT session_id, turn*10+3 FROM b WHERE tool AND conv_id % 5 <> 0
  UNION ALL SELECT session_id, turn*10+k FROM b, (VALUES (4), (5)) h(k) WHERE tool
  UNION ALL SELECT session_id, 7 FROM b WHERE turn = 0 AND conv_id % 7 IN (0, 3)
  UNION ALL SELECT session_id, k FROM b, (VALUES (8), (9)) h(k) WHERE turn = 0 AND conv_id % 7 = 0)
"""


@area.query(
    "cursor_alignment",
    BASE + LINE_OFFSETS
    + """SELECT session_id, min(off) FILTER (off >= 13) AS next_unit, max(off) FILTER (off <= 13) AS prev_unit FROM l GROUP BY 1""",
)
def cursor_alignment(spark, sf_dir):
    return T.align_cursor(fixture_a.lines(spark, sf_dir), F.lit(13))


@area.query(
    "line_failures",
    BASE + LINE_OFFSETS
    + """SELECT session_id, count(*) AS lines, count(*) FILTER (off = 8) AS failed FROM l GROUP BY 1""",
)
def line_failures(spark, sf_dir):
    return A.bad_lines(fixture_a.lines(spark, sf_dir))


SESSION_USAGE = """
  coalesce(sum(n) FILTER (used), 0)::BIGINT AS input_tokens, coalesce(sum(turn) FILTER (used), 0)::BIGINT AS output_tokens,
  coalesce(sum(n % 7 + n % 3) FILTER (used), 0)::BIGINT AS cache_tokens,
  coalesce(sum(n + turn + n % 7 + n % 3) FILTER (used), 0)::BIGINT AS total_tokens"""


@area.query(
    "session_summaries",
    BASE
    + f""", x AS (SELECT *, role = 'assistant' AS used,
       CASE WHEN role = 'user' AND NOT (noisy AND conv_id % 2 = 0) THEN text END AS prompt FROM b)
    SELECT session_id,
      CASE WHEN conv_id % 7 = 0 THEN 'Title ' || session_id WHEN conv_id % 7 = 3 THEN 'Sum ' || session_id END AS agent_title,
      arg_min(prompt, turn) FILTER (prompt IS NOT NULL) AS first_prompt,
      arg_min(ts, turn) FILTER (role <> 'system') AS created_at, arg_max(ts, turn) FILTER (role <> 'system') AS updated_at,
      CASE WHEN count(*) FILTER (role = 'user') > 0 THEN '/work/p' || (conv_id % 17) END AS project_path,
      {SESSION_USAGE} FROM x GROUP BY session_id, conv_id""",
)
def session_summaries(spark, sf_dir):
    return A.sessions(fixture_a.lines(spark, sf_dir))


@area.query(
    "lazy_first_prompt",
    BASE
    + """SELECT session_id, arg_min(CASE WHEN noisy THEN '<local-command>' || text ELSE text END, turn) AS first_prompt
    FROM b WHERE role = 'user' AND conv_id % 2 = 0 GROUP BY 1""",
)
def lazy_first_prompt(spark, sf_dir):
    return A.lazy_first_prompt(fixture_a.lines(spark, sf_dir))


@area.query(
    "usage_by_source",
    BASE
    + """, x AS (SELECT *, role = 'assistant' AS used FROM b)
    SELECT 'claude' AS source, count(DISTINCT session_id) AS sessions, """
    + SESSION_USAGE
    + " FROM x",
)
def usage_by_source(spark, sf_dir):
    per_session = A.sessions(fixture_a.lines(spark, sf_dir)).withColumn("source", F.lit(A.SOURCE))
    return per_session.groupBy("source").agg(
        F.count("*").alias("sessions"), *[F.sum(c).cast("bigint").alias(c) for c in USAGE_COLUMNS]
    )


@area.query(
    "usage_per_turn_model",
    BASE
    + """SELECT 'claude-opus-4-' || (6 + conv_id % 2) AS model, count(*) AS turns,
    sum(n)::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens FROM b WHERE role = 'assistant' GROUP BY 1""",
)
def usage_per_turn_model(spark, sf_dir):
    """Usage attributed to the model of each turn, not to the first model of the session."""
    return A.usage_by_turn_model(fixture_a.lines(spark, sf_dir)).select("model", "turns", "input_tokens", "output_tokens")


@area.query(
    "session_search_messages",
    RECORDS
    + """, h AS (
      SELECT session_id, turn*10 AS unit, 'user' AS record_type, text AS t, ts FROM b
        WHERE role = 'user' AND NOT (noisy AND conv_id % 2 = 0) AND contains(lower(text), 'the')
      UNION ALL SELECT session_id, turn*10, CASE WHEN contains(lower(text), 'the') THEN 'assistant' ELSE 'thinking' END, text, ts
        FROM b WHERE plain AND contains(lower(text), 'the')
      UNION ALL SELECT session_id, turn*10, 'assistant', left(text, 10), ts FROM b WHERE chunked AND contains(lower(left(text, 10)), 'the')
      UNION ALL SELECT session_id, turn*10+1, 'assistant', substr(text, 11), ts FROM b WHERE chunked AND contains(lower(substr(text, 11)), 'the')
      UNION ALL SELECT session_id, turn*10, 'assistant', text, ts FROM b WHERE tool AND contains(lower(text), 'the')
      UNION ALL SELECT session_id, turn*10+3, 'tool_result', text, ts FROM b WHERE tool AND conv_id % 5 <> 0 AND contains(lower(text), 'the')),
    k AS (SELECT *, strpos(lower(t), 'the') - 1 AS pos FROM h)
    SELECT session_id, unit, record_type, ts,
      CASE WHEN pos > 40 THEN '...' ELSE '' END || substr(t, greatest(pos - 40, 0) + 1, least(pos + 103, length(t)) - greatest(pos - 40, 0))
      || CASE WHEN pos + 103 < length(t) THEN '...' ELSE '' END AS snippet FROM k""",
)
def session_search_messages(spark, sf_dir):
    return A.search_hits(fixture_a.lines(spark, sf_dir), "the")


@area.query(
    "index_texts_messages",
    BASE
    + """, t AS (
      SELECT session_id, turn*10 AS unit, 'content' AS kind, text FROM b WHERE (role = 'user' AND NOT (noisy AND conv_id % 2 = 0)) OR plain OR tool
      UNION ALL SELECT session_id, turn*10, 'content', left(text, 10) FROM b WHERE chunked
      UNION ALL SELECT session_id, turn*10+1, 'content', substr(text, 11) FROM b WHERE chunked
      UNION ALL SELECT session_id, turn*10, 'reasoning', left(text, 30) FROM b WHERE plain AND n % 3 = 0
      UNION ALL SELECT session_id, turn*10+3, 'tool', text FROM b WHERE tool AND conv_id % 5 <> 0)
    SELECT * FROM t WHERE trim(text) <> ''""",
)
def index_texts_messages(spark, sf_dir):
    return A.texts(fixture_a.lines(spark, sf_dir)).select("session_id", "unit", "kind", "text")


@area.query(
    "tool_profile_messages",
    BASE
    + """SELECT 'Bash' AS tool_name, count(*) AS calls, count(*) FILTER (conv_id % 5 <> 0) AS answered, 0::BIGINT AS errors,
       0::BIGINT AS duration_ms, 0::BIGINT AS file_calls FROM b WHERE tool HAVING count(*) > 0
    UNION ALL SELECT 'Read', count(*), 0, 0, 0, count(*) FROM b WHERE tool AND conv_id % 3 = 0 HAVING count(*) > 0""",
)
def tool_profile_messages(spark, sf_dir):
    return T.tool_profile(T.pair_calls(record_table(spark, sf_dir)))


@area.query(
    "message_model_contexts",
    BASE + "SELECT session_id, '-/claude-opus-4-' || (6 + conv_id % 2) || '/-' AS contexts FROM b WHERE role = 'assistant' GROUP BY session_id, conv_id",
)
def message_model_contexts(spark, sf_dir):
    arrays = models.context_arrays(A.model_turns(fixture_a.lines(spark, sf_dir)))
    return arrays.select("session_id", models.context_text(F.col("model_contexts")).alias("contexts"))


@area.query(
    "session_documents",
    BASE
    + """SELECT session_id, '/h/projects/p/' || session_id || '.jsonl' AS key, sum(strlen(text)) || ':' || (1767312000 + conv_id * 3600) AS version,
      sum(strlen(text))::BIGINT AS file_size_bytes,
      coalesce(arg_min(ts, turn) FILTER (role <> 'system'), strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id), '%Y-%m-%d %H:%M:%S')) AS created_at,
      coalesce(arg_max(ts, turn) FILTER (role <> 'system'), strftime(TIMESTAMP '2026-01-02' + to_hours(conv_id), '%Y-%m-%d %H:%M:%S')) AS updated_at,
      CASE WHEN conv_id < 5 THEN (SELECT count(DISTINCT k.conv_id) FROM b k WHERE k.conv_id % 5 = b.conv_id) ELSE 0 END AS subagent_count
    FROM b GROUP BY session_id, conv_id""",
)
def session_documents(spark, sf_dir):
    """Sessions with file size, version, times and number of sub-agents."""
    conv = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("size"))
    sid = F.concat(F.lit("c"), conv.cast("string"))
    born = F.timestamp_seconds(F.lit(fixture_a.EPOCH_2026) + conv * 3600)
    files = rows.select(
        sid.alias("session_id"), F.concat(F.lit("/h/projects/p/"), sid, F.lit(".jsonl")).alias("path"), "size", born.alias("created"),
        (born + F.expr("interval 1 day")).alias("mtime"),
    )
    sidecars = rows.select(F.concat(F.lit("c"), (conv % 5).cast("string")).alias("session_id"), conv.alias("agent_id"))
    docs = A.with_files(A.sessions(fixture_a.lines(spark, sf_dir)), files, sidecars)
    return docs.select("session_id", "key", "version", "file_size_bytes", "created_at", "updated_at", "subagent_count")
