"""Dialects C (relational) and D (header plus tree entries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.operators import models
from skeinlog.operators import timeline as T
from skeinlog.session import cut_lineage
from skeinlog.sources import dialect_c as C
from skeinlog.sources import dialect_d as D
from workload import fixture_cd as fx
from workload.registry import Area, snippet_sql
from workload.tables import table

area = Area()

C_BASE = """
WITH RECURSIVE b AS (
  SELECT conv_id, turn, role, text, length(text) AS n, 'o' || conv_id AS session_id, 'm-' || conv_id || '-' || turn AS message_id,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, 'm-' || conv_id || '-' || turn) - 1 AS position,
    strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(turn // 2), '%Y-%m-%d %H:%M:%S') AS ts,
    role = 'assistant' AS a FROM conversations),
s AS (
  SELECT DISTINCT session_id AS id, conv_id, CASE WHEN conv_id % 20 <> 0 THEN 'o' || (conv_id - 1) WHEN conv_id % 100 = 20 THEN 'gone-' || conv_id END AS parent_id FROM b),
up(id, cur, d) AS (
  SELECT id, id, 0 FROM s UNION ALL
  SELECT up.id, s.parent_id, d + 1 FROM up JOIN s ON s.id = up.cur WHERE s.parent_id IS NOT NULL),
roots AS (SELECT id AS session_id, arg_max(cur, d) AS root_id FROM up GROUP BY 1)
"""

C_RECORDS = C_BASE + """
, t AS (  -- tool parts with their text forms
  SELECT *, CASE turn % 8 WHEN 1 THEN 'read' WHEN 3 THEN 'bash' WHEN 5 THEN 'write' WHEN 7 THEN 'edit' WHEN 2 THEN 'question' END AS tool,
    CASE turn % 8 WHEN 1 THEN '{"file_path":"/a/b.py"}' WHEN 3 THEN '{"command":' || to_json(left(text, 12)) || '}'
      WHEN 5 THEN '{"content":' || to_json(left(text, 8)) || ',"file_path":"/a/c.py"}' WHEN 7 THEN '{"input":"+x"}'
      WHEN 2 THEN '{"questions":[{"question":"Go on?"},{"question":"Why?"}]}' END AS tool_input,
    CASE turn % 8 WHEN 1 THEN regexp_replace(regexp_replace(text, '^\\n+', ''), '\\n+$', '') WHEN 3 THEN text WHEN 5 THEN left(text, 8) WHEN 7 THEN 'ok' WHEN 2 THEN 'answered' END AS output
  FROM b WHERE a AND turn % 8 IN (1, 3, 5, 7, 2)),
p AS (
  SELECT session_id, position, ts, 0 AS k, 0 AS i, CASE WHEN a THEN 'assistant' ELSE 'user' END AS record_type, 'content' AS level, text AS content,
     NULL AS tool_name, NULL AS tool_use_id, NULL AS tool_input, NULL AS result_meta FROM b
  UNION ALL SELECT session_id, position, ts, 1, 0, 'thinking', 'content', left(text, 30), NULL, NULL, NULL, NULL FROM b WHERE a AND n % 3 = 0
  UNION ALL SELECT session_id, position, ts, 2, 0, 'assistant', CASE WHEN tool = 'question' THEN 'content' ELSE 'tool' END, '', tool,
     'call-' || conv_id || '-' || turn, tool_input, NULL FROM t
  UNION ALL SELECT session_id, position, ts, 2, 1, 'tool_result', CASE WHEN tool = 'question' THEN 'content' ELSE 'tool' END, output, NULL,
     'call-' || conv_id || '-' || turn, NULL,
     CASE WHEN tool = 'question' THEN '{"answers":{"Go on?":["Yes"],"Why?":[]}}' WHEN conv_id % 4 = 2 THEN '{"terminal":{"exit_code":1}}' END
     FROM t WHERE conv_id % 4 <> 3
  UNION ALL SELECT session_id, position, ts, 3, 0, 'assistant', 'tool', '', 'Agent', 'call-' || conv_id || '-' || turn,
     '{"subagent_type":"explore"}', NULL FROM b WHERE a AND turn IN (1, 2)
  UNION ALL SELECT session_id, position, ts, 3, 1, 'tool_result', 'tool', 'done', NULL, 'call-' || conv_id || '-' || turn, NULL,
     CASE WHEN conv_id % 4 = 2 THEN '{"terminal":{"exit_code":1}}' END FROM b WHERE a AND turn IN (1, 2) AND conv_id % 4 <> 3
  UNION ALL SELECT session_id, position, ts, 4, 0, 'usage', 'debug', 'tokens · input ' || n || ' · output ' || turn || ' · reasoning ' || (n % 5) ||
     ' · cache read ' || (n % 7) || ' write ' || (n % 3), NULL, NULL, NULL, NULL FROM b WHERE a
  UNION ALL SELECT session_id, position, ts, 5, 0, 'assistant', 'tool', '', 'patch', 'h' || conv_id || '-' || turn,
     '{"files":["a","b"],"hash":"h' || conv_id || '-' || turn || '"}', NULL FROM b WHERE a AND turn % 6 = 4
  UNION ALL SELECT session_id, position, ts, 6, 0, 'meta', 'content', 'context compacted', NULL, NULL, NULL, NULL FROM b WHERE role = 'system'),
r AS (SELECT *, position AS unit, row_number() OVER (PARTITION BY session_id, position ORDER BY k, i) - 1 AS seq FROM p)
"""


def _c(spark, sf_dir):
    return fx.c_sessions(spark, sf_dir), fx.c_messages(spark, sf_dir), fx.c_parts(spark, sf_dir)


@area.query("message_cursors", C_BASE + "SELECT session_id, message_id AS id, position FROM b")
def message_cursors(spark, sf_dir):
    return C.message_positions(fx.c_messages(spark, sf_dir)).select("session_id", "id", "position")


@area.query(
    "positions_of_a_hot_session",
    """WITH m AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 's' || (event_id % 41) END AS session_id, 'm' || event_id AS id, (event_id * 7919) % 40009 AS t FROM events)
    SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY t, id) - 1 AS position FROM m""",
)
def positions_of_a_hot_session(spark, sf_dir):
    """One session holds a third of the messages, all within a minute."""
    e = F.col("event_id")
    session = F.when(e % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (e % 41).cast("string")))
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), e.cast("string")).alias("id"), session.alias("session_id"), F.lit("{}").alias("data"), ((e * 7919) % 40009).alias("time_created")
    )
    return C.message_positions(rows, 500).select("session_id", "id", "position")


@area.query(
    "relational_records",
    C_RECORDS
    + "SELECT session_id, unit, seq, record_type, level, content, ts, tool_name, tool_use_id, tool_input, result_meta FROM r",
)
def relational_records(spark, sf_dir):
    _, messages, parts = _c(spark, sf_dir)
    return C.records(messages, parts).select(
        "session_id", "unit", "seq", "record_type", "level", "content", "ts", "tool_name", "tool_use_id", "tool_input", "result_meta"
    )


@area.query(
    "relational_tail_page",
    C_RECORDS
    + """, u AS (SELECT session_id, position, count(*) AS n FROM r GROUP BY 1, 2),
    k AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY session_id ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM u)
    SELECT session_id, min(position) AS start_unit, max(position) AS last_unit, sum(n)::BIGINT AS page_records,
      (min(position) > 0)::INT AS has_earlier, 0 AS has_more FROM k WHERE taken < 6 GROUP BY 1""",
)
def relational_tail_page(spark, sf_dir):
    _, messages, parts = _c(spark, sf_dir)
    recs = cut_lineage(C.records(messages, parts), "records")
    return T.page_info(recs, T.backward_page(recs, 6))


@area.query(
    "tool_profile_relational",
    C_RECORDS
    + """, c AS (SELECT session_id, tool_use_id, arg_max(tool_name, (unit, seq)) AS tool_name, arg_max(tool_input, (unit, seq)) AS tool_input FROM r WHERE tool_name IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT session_id, tool_use_id, arg_max(coalesce(result_meta, ''), (unit, seq)) AS meta FROM r WHERE record_type = 'tool_result' GROUP BY 1, 2)
    SELECT tool_name, count(*) AS calls, count(x.meta) AS answered, count(*) FILTER (x.meta LIKE '%exit_code":1%') AS errors, 0::BIGINT AS duration_ms,
      count(*) FILTER (tool_input LIKE '%"file_path"%') AS file_calls FROM c LEFT JOIN x USING (session_id, tool_use_id) GROUP BY 1""",
)
def tool_profile_relational(spark, sf_dir):
    """Tools of which a quarter of the sessions' calls fail."""
    _, messages, parts = _c(spark, sf_dir)
    return T.tool_profile(T.pair_calls(cut_lineage(C.records(messages, parts), "records")))


@area.query("session_roots", C_BASE + "SELECT session_id, root_id FROM roots")
def session_roots(spark, sf_dir):
    return C.roots(fx.c_sessions(spark, sf_dir))


@area.query(
    "orphaned_sessions",
    C_BASE + "SELECT root_id, count(*) AS sessions FROM roots WHERE root_id NOT IN (SELECT id FROM s WHERE parent_id IS NULL) GROUP BY 1",
)
def orphaned_sessions(spark, sf_dir):
    sessions = fx.c_sessions(spark, sf_dir)
    return C.orphaned(sessions, C.roots(sessions)).groupBy("root_id").agg(F.count("*").alias("sessions"))


@area.query(
    "step_usage_rollup",
    C_BASE
    + """SELECT root_id AS session_id, sum(n)::BIGINT AS input_tokens, sum(turn + n % 5)::BIGINT AS output_tokens,
    sum(n % 7 + n % 3)::BIGINT AS cache_tokens, sum(n + turn + n % 5 + n % 7 + n % 3)::BIGINT AS total_tokens
    FROM b JOIN roots USING (session_id) WHERE a GROUP BY 1""",
)
def step_usage_rollup(spark, sf_dir):
    sessions, _, parts = _c(spark, sf_dir)
    return C.usage(parts, C.roots(sessions))


@area.query(
    "relational_sessions",
    C_BASE
    + """SELECT 'o' || conv_id AS session_id, '/work/p' || (conv_id % 17) AS project_path, CASE WHEN conv_id % 4 <> 0 THEN 'T' || conv_id END AS agent_title,
    strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id), '%Y-%m-%d %H:%M') AS created_at,
    strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(count(*)), '%Y-%m-%d %H:%M') AS updated_at,
    count(*) AS message_count, count(*) * 400 AS file_size_bytes,
    coalesce((SELECT count(*) FROM s k WHERE k.parent_id = 'o' || b.conv_id), 0) AS subagent_count
    FROM b WHERE conv_id % 20 = 0 AND conv_id % 100 <> 20 GROUP BY conv_id""",
)
def relational_sessions(spark, sf_dir):
    sessions, messages, _ = _c(spark, sf_dir)
    return C.session_list(sessions, messages)


@area.query(
    "task_subagents",
    C_BASE
    + """SELECT s.parent_id AS session_id, s.id AS agent_id,
      CASE WHEN k.conv_id IS NOT NULL AND k.conv_id % 3 = 0 THEN 'planner' WHEN k.conv_id IS NOT NULL THEN 'explore' ELSE 'subagent' END AS agent_type,
      CASE WHEN s.conv_id % 4 <> 0 THEN ' T' || s.conv_id ELSE '' END AS description,
      coalesce('call-' || k.conv_id || '-' || k.turn, '') AS tool_use_id, (SELECT count(*) FROM b WHERE b.session_id = s.id) AS record_count
    FROM s LEFT JOIN (SELECT conv_id, max(turn) AS turn FROM b WHERE a AND turn IN (1, 2) GROUP BY 1) k ON 'o' || k.conv_id = s.parent_id
    WHERE s.parent_id IS NOT NULL""",
)
def task_subagents(spark, sf_dir):
    return C.subagents(*_c(spark, sf_dir))


@area.query(
    "relational_first_prompts",
    C_BASE
    + """SELECT root_id AS session_id, arg_min(text, conv_id * 1000 + turn) AS first_prompt FROM b JOIN roots USING (session_id) GROUP BY 1""",
)
def relational_first_prompts(spark, sf_dir):
    sessions, _, parts = _c(spark, sf_dir)
    return C.index_first_prompt(parts, C.roots(sessions))


@area.query(
    "relational_user_prompts",
    C_BASE + "SELECT session_id, trim(arg_min(text, turn)) AS first_prompt FROM b WHERE role = 'user' GROUP BY 1",
)
def relational_user_prompts(spark, sf_dir):
    _, messages, parts = _c(spark, sf_dir)
    return C.user_first_prompt(messages, parts)


@area.query(
    "relational_model_contexts",
    C_BASE
    + """, m AS (
      SELECT root_id, -1 AS off, 'openai/gpt-5.4/-' AS c FROM s JOIN roots ON roots.session_id = s.id WHERE conv_id % 3 = 0
      UNION ALL SELECT root_id, -1, 'openai/gpt-5.5/high' FROM s JOIN roots ON roots.session_id = s.id WHERE conv_id % 3 = 1
      UNION ALL SELECT root_id, 0, '-/gpt-5.4-mini/-' FROM b JOIN roots USING (session_id) WHERE a)
    SELECT root_id AS session_id, c AS context FROM m GROUP BY 1, 2""",
)
def relational_model_contexts(spark, sf_dir):
    sessions, messages, _ = _c(spark, sf_dir)
    turns = C.model_turns(sessions, messages, C.roots(sessions))
    arrays = models.context_arrays(turns)
    return arrays.select("session_id", F.explode("model_contexts").alias("c")).select(
        "session_id", models.context_text(F.array("c")).alias("context")
    )


@area.query(
    "session_search_relational",
    C_RECORDS
    + """, h AS (SELECT session_id, position AS unit, 'message' AS record_type, text AS t FROM b
      UNION ALL SELECT session_id, position, 'thinking', left(text, 30) FROM b WHERE a AND n % 3 = 0
      UNION ALL SELECT session_id, position, 'tool_result', CASE tool WHEN 'read' THEN '{"filePath":"/a/b.py"} <path>x</path><content>' || chr(10) || text || chr(10) || '</content>'
         WHEN 'bash' THEN tool_input || ' ' || text WHEN 'write' THEN replace(tool_input, '"file_path"', '"filePath"') || ' Wrote file'
         WHEN 'edit' THEN '{"filePath":"/a/d.py"} ok' ELSE tool_input || ' answered' END FROM t
      UNION ALL SELECT session_id, position, 'tool_result', '{"subagent_type":"explore"} done' FROM b WHERE a AND turn IN (1, 2))
    SELECT session_id, unit, record_type, """
    + snippet_sql("t", "the")
    + " AS snippet FROM h WHERE contains(lower(t), 'the')",
)
def session_search_relational(spark, sf_dir):
    _, messages, parts = _c(spark, sf_dir)
    return C.search_hits(messages, parts, "the")


# --- dialect D ---------------------------------------------------------------------------------------

D_BASE = """
WITH b AS (
  SELECT conv_id, turn, role, text, length(text) AS n, 'pi' || conv_id AS session_id, 'e-' || conv_id || '-' || turn AS eid,
    strftime(TIMESTAMP '2026-01-01' + to_hours(conv_id) + to_minutes(turn), '%Y-%m-%d %H:%M:%S') AS ts,
    role = 'assistant' AS a FROM conversations)
"""


@area.query(
    "tree_entry_records",
    D_BASE
    + """, r AS (
      SELECT session_id, turn*10 AS unit, 0 AS seq, 'meta' AS record_type, 'debug' AS level, 'session ' || session_id || ' · /work/p' || (conv_id % 17) AS content,
         ts, NULL AS tool_name, NULL AS tool_use_id, session_id AS group_id, NULL AS result_meta FROM b WHERE conv_id % 9 <> 8 AND turn = 0 AND conv_id % 9 <> 8
      UNION ALL SELECT session_id, 1, 0, 'meta', 'debug', 'thinking level: low', NULL, NULL, NULL, 'x1', NULL FROM b WHERE conv_id % 9 <> 8 AND turn = 0
      UNION ALL SELECT session_id, 2, 0, 'meta', 'debug', 'model: openai/gpt-5.4', NULL, NULL, NULL, 'x2', NULL FROM b WHERE conv_id % 9 <> 8 AND turn = 0
      UNION ALL SELECT session_id, 23, 0, 'meta', 'debug', 'thinking level: high', NULL, NULL, NULL, 'x3', NULL FROM b WHERE conv_id % 9 <> 8 AND turn = 2
      UNION ALL SELECT session_id, turn*10+4, 0, 'user', 'content', text, ts, NULL, NULL, eid, NULL FROM b WHERE conv_id % 9 <> 8 AND role = 'user'
      UNION ALL SELECT session_id, turn*10+4, 0, 'thinking', 'content', left(text, 30), ts, NULL, NULL, eid, NULL FROM b WHERE conv_id % 9 <> 8 AND a
      UNION ALL SELECT session_id, turn*10+4, 1, 'assistant', 'content', text, ts, NULL, NULL, eid, NULL FROM b WHERE conv_id % 9 <> 8 AND a
      UNION ALL SELECT session_id, turn*10+4, 2, 'assistant', 'tool', '', ts, 'bash', 't-' || eid, eid, NULL FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 3
      UNION ALL SELECT session_id, turn*10+5, 0, 'tool_result', 'tool', text, ts, 'bash', 't-' || eid, eid || 'r',
         CASE WHEN conv_id % 5 = 0 THEN '{"is_error":true}' ELSE '{"is_error":false}' END FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 3
      UNION ALL SELECT session_id, turn*10+6, 0, 'assistant', 'tool', '', ts, 'bash', 'pi-bash-' || eid || 'b', eid || 'b', NULL FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 1
      UNION ALL SELECT session_id, turn*10+6, 1, 'tool_result', 'tool', left(text, 9), ts, 'bash', 'pi-bash-' || eid || 'b', eid || 'b',
         '{"terminal":{"exit_code":' || (conv_id % 3) || ',"cancelled":false,"truncated":false}}' FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 1
      UNION ALL SELECT session_id, turn*10+7, 0, 'meta', 'content', text, ts, NULL, NULL, eid || 'c', NULL FROM b WHERE conv_id % 9 <> 8 AND role = 'system'
      UNION ALL SELECT session_id, 18, 0, 'meta', 'debug', 'session name:  Name ' || session_id, NULL, NULL, NULL, NULL, NULL FROM b WHERE conv_id % 9 <> 8 AND turn = 1 AND conv_id % 4 = 0)
    SELECT * FROM r""",
)
def tree_entry_records(spark, sf_dir):
    return D.records(fx.d_lines(spark, sf_dir)).select(
        "session_id", "unit", "seq", "record_type", "level", "content", "ts", "tool_name", "tool_use_id", "group_id", "result_meta"
    )


@area.query(
    "tree_sessions",
    D_BASE
    + """, u AS (SELECT *, CASE WHEN a THEN n WHEN role = 'system' THEN 5 ELSE 0 END AS i, CASE WHEN a THEN turn WHEN role = 'system' THEN 2 ELSE 0 END AS o,
        CASE WHEN a THEN n % 7 + n % 3 ELSE 0 END AS h FROM b)
    SELECT session_id, session_id AS native_id, '/work/p' || (conv_id % 17) AS project_path, min(ts) AS created_at,
      coalesce(max(ts) FILTER (role <> 'system'), min(ts)) AS updated_at, arg_min(text, turn) FILTER (role = 'user') AS first_prompt,
      CASE WHEN conv_id % 4 = 0 AND max(turn) >= 1 THEN 'Name ' || session_id END AS agent_title,
      sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens, sum(h)::BIGINT AS cache_tokens,
      sum(CASE WHEN a AND conv_id % 2 = 0 THEN n + turn ELSE i + o + h END)::BIGINT AS total_tokens
    FROM u WHERE conv_id % 9 <> 8 GROUP BY session_id, conv_id""",
)
def tree_sessions(spark, sf_dir):
    return D.sessions(fx.d_lines(spark, sf_dir))


@area.query(
    "tree_model_contexts",
    D_BASE
    + """, m AS (
      SELECT session_id, 2 AS off, 'gpt-5.4' AS model, 'low' AS level FROM b WHERE turn = 0
      UNION ALL SELECT session_id, turn*10+4, 'gpt-5.' || (4 + turn % 2), CASE WHEN turn >= 2 THEN 'high' ELSE 'low' END FROM b WHERE a
      UNION ALL SELECT x.session_id, 23, coalesce(p.model, 'gpt-5.4'), 'high' FROM (SELECT session_id FROM b WHERE turn = 2) x
        LEFT JOIN (SELECT session_id, 'gpt-5.' || (4 + max(turn) % 2) AS model FROM b WHERE a AND turn < 2 GROUP BY 1) p USING (session_id)),
    f AS (SELECT session_id, model, level, min(off) AS off FROM m GROUP BY 1, 2, 3)
    SELECT session_id, string_agg('openai/' || model || '/' || level, ',' ORDER BY off) AS contexts FROM f GROUP BY 1""",
)
def tree_model_contexts(spark, sf_dir):
    arrays = models.context_arrays(D.model_turns(fx.d_lines(spark, sf_dir)))
    return arrays.select("session_id", models.context_text(F.col("model_contexts")).alias("contexts"))


@area.query(
    "index_texts_tree",
    D_BASE
    + """, t AS (
      SELECT session_id, turn*10+4 AS unit, 'content' AS kind, text, conv_id FROM b WHERE role = 'user' OR a
      UNION ALL SELECT session_id, turn*10+4, 'reasoning', left(text, 30), conv_id FROM b WHERE a
      UNION ALL SELECT session_id, turn*10+4, 'tool', 'bash {"command":' || to_json(left(text, 12)) || '}', conv_id FROM b WHERE a AND turn % 4 = 3
      UNION ALL SELECT session_id, turn*10+5, 'tool', 'bash ' || text, conv_id FROM b WHERE a AND turn % 4 = 3
      UNION ALL SELECT session_id, turn*10+6, 'tool', 'ls', conv_id FROM b WHERE a AND turn % 4 = 1
      UNION ALL SELECT session_id, turn*10+6, 'tool', left(text, 9), conv_id FROM b WHERE a AND turn % 4 = 1
      UNION ALL SELECT session_id, turn*10+7, 'content', trim(text), conv_id FROM b WHERE role = 'system')
    SELECT session_id, unit, kind, text FROM t WHERE conv_id % 9 <> 8""",
)
def index_texts_tree(spark, sf_dir):
    return D.texts(fx.d_lines(spark, sf_dir)).select("session_id", "unit", "kind", "text")


@area.query(
    "session_search_tree",
    D_BASE
    + """, t AS (
      SELECT session_id, turn*10+4 AS unit, 0 AS seq, 'user' AS record_type, text AS t, ts FROM b WHERE conv_id % 9 <> 8 AND role = 'user'
      UNION ALL SELECT session_id, turn*10+4, 0, 'thinking', left(text, 30), ts FROM b WHERE conv_id % 9 <> 8 AND a
      UNION ALL SELECT session_id, turn*10+4, 1, 'assistant', text, ts FROM b WHERE conv_id % 9 <> 8 AND a
      UNION ALL SELECT session_id, turn*10+4, 2, 'tool', ' bash {"command":' || to_json(left(text, 12)) || '}', ts FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 3
      UNION ALL SELECT session_id, turn*10+5, 0, 'tool', text || ' bash', ts FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 3
      UNION ALL SELECT session_id, turn*10+6, 1, 'tool', left(text, 9) || ' bash', ts FROM b WHERE conv_id % 9 <> 8 AND a AND turn % 4 = 1
      UNION ALL SELECT session_id, turn*10+7, 0, 'meta', text, ts FROM b WHERE conv_id % 9 <> 8 AND role = 'system')
    SELECT session_id, unit, seq, record_type, ts, """
    + snippet_sql("t", "the")
    + " AS snippet FROM t WHERE contains(lower(t), 'the')",
)
def session_search_tree(spark, sf_dir):
    return D.search_hits(fx.d_lines(spark, sf_dir), "the")
