"""Dialect B: envelopes, thread trees, counters, sub-agent links, side tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators import models
from skeinlog.plans import forest as forests
from skeinlog.plans import index as I
from skeinlog.plans import segments as G
from skeinlog.session import cut_lineage, scratch_path
from skeinlog.sources import dialect_b as B
from workload import fixture_b
from workload.registry import Area, snippet_sql
from workload.tables import exists, table

area = Area()

BASE = """
WITH RECURSIVE e AS (
  SELECT event_id AS e, event_id::VARCHAR AS id, event_id % 3 <> 0 AS sub, CAST(ROUND(value*100) AS BIGINT) AS c,
         CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 97 = 5 THEN 'missing-' || event_id ELSE (event_id // 3)::VARCHAR END END AS parent,
         CASE WHEN event_id % 3 <> 0 AND event_id % 29 = 1 THEN ((event_id % 7) * 3)::VARCHAR
              WHEN event_id % 3 <> 0 AND event_id % 31 = 2 THEN '1' END AS hint,
         strftime(TIMESTAMP '2026-01-01' + to_minutes(event_id), '%Y-%m-%d %H:%M:%S') AS ts
  FROM events),
nodes AS (
  SELECT a.id, CASE WHEN a.sub THEN coalesce(CASE WHEN h.id IS NOT NULL AND NOT h.sub THEN h.id END, p.id) END AS next
  FROM e a LEFT JOIN e h ON h.id = a.hint LEFT JOIN e p ON p.id = a.parent),
up(id, cur, d) AS (
  SELECT id, id, 0 FROM nodes UNION ALL SELECT up.id, n.next, d + 1 FROM up JOIN nodes n ON n.id = up.cur WHERE n.next IS NOT NULL),
roots AS (SELECT id, arg_max(cur, d) AS root_id FROM up GROUP BY id)
"""

USAGE = """
, u AS (
  SELECT id, sub, e,
    c + 100 + e % 13 AS ti, c % 11 + 5 AS t_o, c % 7 + 1 AS tc, CASE WHEN e % 23 = 4 THEN 1 ELSE c + c % 11 + 135 END AS tt,
    c AS bi, c % 11 AS bo, c % 7 AS bc, c + c % 11 AS bt FROM e),
own AS (
  SELECT id, CASE WHEN s THEN greatest(ti - bi, 0) ELSE ti END AS input_tokens, CASE WHEN s THEN greatest(t_o - bo, 0) ELSE t_o END AS output_tokens,
    CASE WHEN s THEN greatest(tc - bc, 0) ELSE tc END AS cache_tokens, CASE WHEN s THEN greatest(tt - bt, 0) ELSE tt END AS total_tokens
  FROM (SELECT *, sub AND e % 4 <> 1 AND tt >= bt AS s FROM u))
"""


def lines(spark, sf_dir) -> DataFrame:
    return fixture_b.lines(spark, sf_dir)


_forests: dict[tuple[str, str], str] = {}


def forest(spark: SparkSession, sf_dir: str) -> G.Store:
    """The stored forest of the rollouts, grown in three updates of which later ones bring parents, hints and a changed header, then merged."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _forests or not exists(spark, f"{_forests[key]}/threads"):
        path = scratch_path(spark, "forest")
        store = forests.open_forest(spark, path)
        ident = cut_lineage(B.identities(lines(spark, sf_dir)), "identities")
        part = F.xxhash64("session_id") % 3
        late = ident.where(part == 1).withColumn("parent_id", F.lit("not yet known"))
        forests.update(store, 0, ident.where(part == 0).unionByName(late))
        forests.update(store, 2, ident.where(part != 0))
        forests.merge(store, 3)
        _forests[key] = path
    return forests.open_forest(spark, _forests[key])


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forests.tree(forest(spark, sf_dir))


@area.query(
    "thread_identities",
    BASE
    + """SELECT 'rollout-' || id AS session_id, id AS thread_id, CASE WHEN sub THEN hint ELSE id END AS root_hint, parent AS parent_id,
    sub::INT AS is_subagent, '/work/p' || (e % 17) AS cwd, ts AS started, CASE WHEN sub THEN '/root/task' || id END AS agent_path FROM e""",
)
def thread_identities(spark, sf_dir):
    ident = B.identities(lines(spark, sf_dir))
    return ident.select(
        "session_id", "thread_id", "root_hint", "parent_id", F.col("is_subagent").cast("int").alias("is_subagent"), "cwd", "started", "agent_path"
    )


@area.query("thread_roots", BASE + "SELECT id AS thread_id, root_id FROM roots")
def thread_roots(spark, sf_dir):
    """Roots resolved from nothing."""
    return B.threads(B.identities(lines(spark, sf_dir))).select("thread_id", "root_id")


@area.query("thread_forest", BASE + "SELECT 'rollout-' || id AS session_id, id AS thread_id, root_id FROM roots")
def thread_forest(spark, sf_dir):
    """Roots as the stored forest holds them after its updates."""
    return tree(spark, sf_dir).select("session_id", "thread_id", "root_id")


@area.query(
    "thread_group_document",
    BASE
    + USAGE
    + """, m AS (SELECT e.e, e.id, root_id, e.id <> root_id AS child, ts, '/r/rollout-' || e.id || '.jsonl' AS path, 1000 + e % 50 AS size, e % 5 AS v FROM e JOIN roots USING (id)),
    c AS (SELECT root_id, 'openai/gpt-5.' || (4 + e % 2) || '/high' AS context, min((child, ts, id)) AS place FROM m GROUP BY 1, 2),
    x AS (SELECT root_id, string_agg(context, ',' ORDER BY place) AS contexts FROM c GROUP BY 1)
    SELECT root_id, '/r/rollout-' || root_id || '.jsonl' AS key, count(*) || ':' || sum(('0x' || substr(md5(path || '@v' || v), 1, 12))::BIGINT) AS version,
      sum(size)::BIGINT AS file_size_bytes, count(*) FILTER (child) AS subagent_count, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
      sum(cache_tokens)::BIGINT AS cache_tokens, sum(total_tokens)::BIGINT AS total_tokens, any_value(contexts) AS contexts
    FROM m JOIN own USING (id) JOIN x USING (root_id) GROUP BY root_id""",
)
def thread_group_document(spark, sf_dir):
    e = F.col("event_id")
    session = F.concat(F.lit("rollout-"), e.cast("string"))
    files = table(spark, sf_dir, "events").select(
        session.alias("session_id"), F.concat(F.lit("/r/"), session, F.lit(".jsonl")).alias("path"), (e % 50 + 1000).alias("size"), F.concat(F.lit("v"), (e % 5).cast("string")).alias("version")
    )
    docs = B.group_documents(lines(spark, sf_dir), tree(spark, sf_dir), files)
    return docs.withColumn("contexts", models.context_text("model_contexts")).drop("model_contexts")


@area.query(
    "cumulative_usage_last",
    BASE + USAGE + "SELECT 'rollout-' || id AS session_id, ti AS input_tokens, t_o AS output_tokens, tc AS cache_tokens, tt AS total_tokens FROM u",
)
def cumulative_usage_last(spark, sf_dir):
    return B.latest_usage(lines(spark, sf_dir))


@area.query(
    "subagent_token_delta",
    BASE + USAGE + "SELECT id AS thread_id, input_tokens, output_tokens, cache_tokens, total_tokens FROM own",
)
def subagent_token_delta(spark, sf_dir):
    src = lines(spark, sf_dir)
    own = B.own_usage(src, B.identities(src))
    return own.select("thread_id", "input_tokens", "output_tokens", "cache_tokens", "total_tokens")


@area.query(
    "thread_group_rollup",
    BASE
    + USAGE
    + """SELECT root_id, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
    sum(cache_tokens)::BIGINT AS cache_tokens, sum(total_tokens)::BIGINT AS total_tokens,
    count(*) FILTER (id <> root_id) AS subagent_count FROM own JOIN roots USING (id) GROUP BY 1""",
)
def thread_group_rollup(spark, sf_dir):
    return B.group_rollup(B.own_usage(lines(spark, sf_dir), tree(spark, sf_dir)))


@area.query(
    "subagent_spawn_links",
    BASE
    + """, k AS (SELECT a.id AS thread_id, ra.root_id, a.e, a.parent, rp.root_id AS parent_root
       FROM e a JOIN roots ra USING (id) LEFT JOIN roots rp ON rp.id = (a.e // 3)::VARCHAR WHERE a.id <> ra.root_id)
    SELECT root_id, thread_id,
      CASE WHEN root_id = parent_root AND ((e % 3 = 1) OR (e % 3 = 2 AND (e // 3) % 4 <> 3)) THEN 'sp-' || (e // 3) || '-' || (e % 3) END AS call_id,
      CASE WHEN root_id = parent_root AND e % 3 = 1 THEN '{"task_name":"x' || (e // 3) || '"}'
           WHEN root_id = parent_root AND e % 3 = 2 AND (e // 3) % 4 <> 3 THEN '{"task_name":"task' || e || '"}' END AS args
    FROM k""",
)
def subagent_spawn_links(spark, sf_dir):
    return B.subagent_links(lines(spark, sf_dir), tree(spark, sf_dir))


RECORDS = """
, r AS (
  SELECT id, ts, 0 AS unit, 'meta' AS record_type, 'debug' AS level, 'session · cwd=/work/p' || (e % 17) || ' · provider=openai · cli 1.0' AS content,
         NULL AS tool_name, NULL AS tool_use_id, NULL AS tool_input, NULL AS result_meta FROM e
  UNION ALL SELECT id, ts, 2, 'meta', 'debug', 'session · cwd= · provider= · cli ', NULL, NULL, NULL, NULL FROM e WHERE sub AND e % 7 = 0
  UNION ALL SELECT id, ts, 1, 'turn', 'debug', 'turn · model=gpt-5.' || (4 + e % 2) || ' · effort=high · read-only', NULL, NULL, NULL, NULL FROM e
  UNION ALL SELECT id, ts, k, 'usage', 'debug', 'tokens · input 0 (cached 0) · output 0 (reasoning 0) · total ' ||
      CASE WHEN k = 3 THEN c + c % 11 WHEN e % 23 = 4 THEN 1 ELSE c + c % 11 + 135 END || '/0', NULL, NULL, NULL, NULL FROM e, (VALUES (3), (15)) v(k)
  UNION ALL SELECT id, ts, 5, CASE WHEN e % 6 = 0 THEN 'meta' ELSE 'user' END, CASE WHEN e % 6 = 0 THEN 'debug' ELSE 'content' END,
      CASE WHEN e % 6 = 0 THEN ' <env>' || id ELSE 'Prompt ' || id END, NULL, NULL, NULL, NULL FROM e
  UNION ALL SELECT id, ts, 10, 'assistant', 'tool', '', 'spawn_agent', 'sp-' || id || '-1', '{"task_name":"x' || id || '"}', NULL FROM e
  UNION ALL SELECT id, ts, 11, 'tool_result', 'tool', '{"agent_id":"' || (3*e+1) || '"}', NULL, 'sp-' || id || '-1', NULL, NULL FROM e WHERE e % 2 = 1
  UNION ALL SELECT id, ts, 12, 'assistant', 'tool', '', 'spawn_agent', 'sp-' || id || '-2', '{"task_name":"task' || (3*e+2) || '"}', NULL FROM e WHERE e % 4 <> 3
  UNION ALL SELECT id, ts, 13, 'assistant', 'tool', '', 'shell_command', 'sh-' || id, '{"command":"ls ' || id || '"}', NULL FROM e
  UNION ALL SELECT id, ts, 14, 'tool_result', 'tool', 'line ' || id, NULL, 'sh-' || id, NULL,
      '{"terminal":{"exit_code":' || (e % 4) || ',"duration_ms":' || (((e % 30) // 10) * 1000 + (e % 10) * 100) || '}}' FROM e
  UNION ALL SELECT id, ts, 16, 'thinking', 'content', 'Think ' || id, NULL, NULL, NULL, NULL FROM e
  UNION ALL SELECT id, ts, 17, 'assistant', 'content', 'Answer ' || id, NULL, NULL, NULL, NULL FROM e
  UNION ALL SELECT id, ts, 18, 'assistant', 'content', '', 'ask_user_question', 'ask-' || id,
      '{"questions":[{"id":"q1","question":"Which ' || id || '?"},{"id":"q2","question":"Why?"},{"id":"q3","question":"When?"}]}', NULL FROM e WHERE e % 9 = 0
  UNION ALL SELECT id, ts, 19, 'tool_result', 'content', '', NULL, 'ask-' || id, NULL,
      '{"answers":{"Which ' || id || '?":["A","B"],"Why?":["C"]}}' FROM e WHERE e % 9 = 0
)
"""
COLS = ["session_id", "unit", "record_type", "level", "content", "ts", "tool_name", "tool_use_id", "tool_input", "result_meta"]


@area.query(
    "envelope_records",
    BASE + RECORDS + "SELECT 'rollout-' || id AS session_id, unit, record_type, level, content, ts, tool_name, tool_use_id, tool_input, result_meta FROM r",
)
def envelope_records(spark, sf_dir):
    return B.records(lines(spark, sf_dir)).select(*COLS)


@area.query(
    "subagent_timelines",
    BASE + RECORDS + """SELECT root_id, id AS thread_id, count(*) AS records, count(*) FILTER (record_type = 'tool_result') AS results
    FROM r JOIN roots USING (id) JOIN e USING (id) WHERE level <> 'debug' AND sub AND id <> root_id GROUP BY 1, 2""",
)
def subagent_timelines(spark, sf_dir):
    """Records are counted per file before they meet the tree: a row per file is dealt out, not every record."""
    recs = B.records(lines(spark, sf_dir)).withColumn("result", F.when(F.col("record_type") == "tool_result", 1))
    child = B.child_timeline(recs, tree(spark, sf_dir), F.count("*").alias("records"), F.count("result").alias("results"))
    return child.groupBy("root_id", "thread_id").agg(F.sum("records").alias("records"), F.sum("results").alias("results"))


@area.query(
    "shell_output_profile",
    BASE
    + """SELECT e % 4 AS exit_code, count(*) AS results, sum(((e % 30) // 10) * 1000 + (e % 10) * 100)::BIGINT AS duration_ms,
    sum(length('line ' || id))::BIGINT AS body_chars FROM e GROUP BY 1""",
)
def shell_output_profile(spark, sf_dir):
    meta = F.try_parse_json("result_meta")
    recs = B.records(lines(spark, sf_dir), "tool").where(F.try_variant_get(meta, "$.terminal", "variant").isNotNull())
    return recs.groupBy(F.try_variant_get(meta, "$.terminal.exit_code", "bigint").alias("exit_code")).agg(
        F.count("*").alias("results"),
        F.sum(F.try_variant_get(meta, "$.terminal.duration_ms", "bigint")).alias("duration_ms"),
        F.sum(F.length("content")).cast("bigint").alias("body_chars"),
    )


@area.query(
    "question_answers",
    BASE + """SELECT 'rollout-' || id AS session_id, q AS question, n AS answers FROM e, LATERAL (VALUES ('Which ' || id || '?', 'A|B'), ('Why?', 'C')) v(q, n)
    WHERE e % 9 = 0""",
)
def question_answers(spark, sf_dir):
    recs = B.records(lines(spark, sf_dir), "content")
    answers = F.try_variant_get(F.try_parse_json("result_meta"), "$.answers", "map<string,array<string>>")
    return recs.select("session_id", F.explode(answers).alias("question", "labels")).select(
        "session_id", "question", F.array_join("labels", "|").alias("answers")
    )


@area.query(
    "envelope_first_prompts",
    BASE + "SELECT 'rollout-' || id AS session_id, 'Prompt ' || id AS first_prompt FROM e WHERE e % 6 <> 0",
)
def envelope_first_prompts(spark, sf_dir):
    return B.first_prompts(lines(spark, sf_dir))


@area.query(
    "envelope_model_contexts",
    BASE + "SELECT 'rollout-' || id AS session_id, 'openai/gpt-5.' || (4 + e % 2) || '/high' AS contexts FROM e",
)
def envelope_model_contexts(spark, sf_dir):
    src = lines(spark, sf_dir)
    arrays = models.context_arrays(B.model_turns(src, B.identities(src)))
    return arrays.select("session_id", models.context_text(F.col("model_contexts")).alias("contexts"))


@area.query(
    "index_texts_envelopes",
    BASE
    + """, t AS (
      SELECT id, 5 AS unit, 'content' AS kind, 'Prompt ' || id AS text FROM e WHERE e % 6 <> 0
      UNION ALL SELECT id, 11, 'tool', '{"agent_id":"' || (3*e+1) || '"}' FROM e WHERE e % 2 = 1
      UNION ALL SELECT id, 13, 'tool', 'ls ' || id FROM e
      UNION ALL SELECT id, 14, 'tool', 'Exit code: ' || (e % 4) || chr(10) || 'Wall time: ' || ((e % 30) // 10) || '.' || (e % 10) || ' seconds' || chr(10) || 'Output:' || chr(10) || 'line ' || id FROM e
      UNION ALL SELECT id, 16, 'reasoning', 'Think ' || id FROM e
      UNION ALL SELECT id, 17, 'content', 'Answer ' || id FROM e
      UNION ALL SELECT id, 19, 'tool', '{"answers":{"q1":{"answers":["A","B"]},"q2":["C"]}}' FROM e WHERE e % 9 = 0)
    SELECT 'rollout-' || id AS session_id, unit, kind, text FROM t""",
)
def index_texts_envelopes(spark, sf_dir):
    return B.texts(lines(spark, sf_dir)).select("session_id", "unit", "kind", "text")


@area.query(
    "session_search_envelopes",
    BASE
    + """, t AS (
      SELECT id, ts, 5 AS unit, 'user' AS record_type, CASE WHEN e % 6 = 0 THEN ' <env>' ELSE 'Prompt ' END || id AS t FROM e
      UNION ALL SELECT id, ts, 10, 'tool', '{"task_name":"x' || id || '"}' FROM e
      UNION ALL SELECT id, ts, 11, 'tool_result', '{"agent_id":"' || (3*e+1) || '"}' FROM e WHERE e % 2 = 1
      UNION ALL SELECT id, ts, 12, 'tool', '{"task_name":"task' || (3*e+2) || '"}' FROM e WHERE e % 4 <> 3
      UNION ALL SELECT id, ts, 13, 'tool', '{"command":"ls ' || id || '"}' FROM e
      UNION ALL SELECT id, ts, 14, 'tool_result', 'Exit code: ' || (e % 4) || chr(10) || 'Wall time: ' || ((e % 30) // 10) || '.' || (e % 10) || ' seconds' || chr(10) || 'Output:' || chr(10) || 'line ' || id FROM e
      UNION ALL SELECT id, ts, 16, 'thinking', 'Think ' || id FROM e
      UNION ALL SELECT id, ts, 17, 'assistant', 'Answer ' || id FROM e
      UNION ALL SELECT id, ts, 18, 'tool', '{"questions":[{"id":"q1","question":"Which ' || id || '?"},{"id":"q2","question":"Why?"},{"id":"q3","question":"When?"}]}' FROM e WHERE e % 9 = 0)
    SELECT 'rollout-' || id AS session_id, unit, record_type, ts, """ + snippet_sql("t", "42") + " AS snippet FROM t WHERE contains(lower(t), '42')",
)
def session_search_envelopes(spark, sf_dir):
    return B.search_hits(lines(spark, sf_dir), "42")


SIDE = BASE + """
, info AS (
  SELECT id, CASE WHEN e % 5 = 2 THEN 'Title ' || id END AS title, strftime(TIMESTAMP '2026-01-01' + to_seconds(e), '%Y-%m-%d %H:%M:%S') AS created,
    CASE WHEN e % 3 <> 0 THEN strftime(TIMESTAMP '2026-01-01' + to_seconds(e + 60), '%Y-%m-%d %H:%M:%S') END AS updated FROM e WHERE e % 2 = 0),
mem AS (
  SELECT id, e, CASE WHEN e % 2 = 0 THEN '- Memory ' || id ELSE 'Summary ' || id || ' é' END AS fallback FROM e WHERE e % 3 = 0)
"""


@area.query(
    "thread_titles",
    SIDE
    + """SELECT e.id AS thread_id, coalesce(info.title, mem.fallback) AS agent_title, coalesce(info.created, e.ts) AS created_at,
    coalesce(info.updated, e.ts) AS updated_at FROM e LEFT JOIN info USING (id) LEFT JOIN mem USING (id)""",
)
def thread_titles(spark, sf_dir):
    src = lines(spark, sf_dir)
    base = B.identities(src).join(B.activity(src), "session_id", "left").select(
        "thread_id", F.col("started").alias("created_at"), F.coalesce("updated_at", "started").alias("updated_at")
    )
    return B.with_thread_info(base, fixture_b.thread_info(spark, sf_dir), fixture_b.memory_outputs(spark, sf_dir))


@area.query(
    "thread_memories",
    SIDE
    + """, m AS (SELECT mem.id, mem.e, coalesce(info.title, mem.fallback) AS name,
      '---' || chr(10) || '<skip>' || chr(10) || '## - Memory ' || mem.id || chr(10) || 'more' || CASE WHEN mem.e % 2 = 0 THEN '' ELSE
        chr(10) || chr(10) || '---' || chr(10) || chr(10) || chr(10) || '# Summary ' || mem.id || ' é' END AS content
      FROM mem LEFT JOIN info USING (id))
    SELECT id || '.md' AS filename, name, CASE WHEN e % 5 <> 0 THEN 'used ' || (e % 7) || ' times · ' ELSE '' END || 'session ' || left(id, 8) AS description,
      strlen(content) AS size_bytes, coalesce(CASE WHEN e % 4 <> 0 THEN e * 10 END, e * 10 + 5) AS recency FROM m""",
)
def thread_memories(spark, sf_dir):
    mem = B.memories(fixture_b.memory_outputs(spark, sf_dir), fixture_b.thread_info(spark, sf_dir))
    return mem.select("filename", "name", "description", "size_bytes", "recency").orderBy(F.col("recency").desc())


@area.query(
    "readable_titles",
    """SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'Title ' || event_id END AS title FROM events WHERE event_id % 2 = 0""",
)
def readable_titles(spark, sf_dir):
    info = fixture_b.thread_info(spark, sf_dir)
    return info.select(F.col("thread_id").cast("bigint").alias("event_id"), X.readable_title(F.col("title")).alias("title"))


@area.query(
    "thread_group_texts",
    BASE
    + """, t AS (
      SELECT id, 5 AS unit, 0 AS code, 'Prompt ' || id AS text FROM e WHERE e % 6 <> 0
      UNION ALL SELECT id, 11, 1, '{"agent_id":"' || (3*e+1) || '"}' FROM e WHERE e % 2 = 1
      UNION ALL SELECT id, 13, 1, 'ls ' || id FROM e
      UNION ALL SELECT id, 14, 1, 'Exit code: ' || (e % 4) || chr(10) || 'Wall time: ' || ((e % 30) // 10) || '.' || (e % 10) || ' seconds' || chr(10) || 'Output:' || chr(10) || 'line ' || id FROM e
      UNION ALL SELECT id, 16, 2, 'Think ' || id FROM e
      UNION ALL SELECT id, 17, 0, 'Answer ' || id FROM e
      UNION ALL SELECT id, 19, 1, '{"answers":{"q1":{"answers":["A","B"]},"q2":["C"]}}' FROM e WHERE e % 9 = 0),
    o AS (SELECT root_id, code, text FROM t JOIN roots USING (id))
    SELECT root_id, code, count(*) AS texts, sum(strlen(text))::BIGINT AS bytes, min(text) AS first_text, max(text) AS last_text FROM o GROUP BY 1, 2""",
)
def thread_group_texts(spark, sf_dir):
    """Index texts of whole groups, on their root."""
    src = lines(spark, sf_dir)
    kept = I.session_texts(B.group_texts(B.texts(src), tree(spark, sf_dir)), ("member", "unit", "seq"))
    return kept.groupBy(F.col("session_key").alias("root_id"), "code").agg(
        F.count("*").alias("texts"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"), F.min("text").alias("first_text"), F.max("text").alias("last_text")
    )
