"""Text and tool-display columns, result shapes, export, and the union of all sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import markdown as M
from skeinlog.functions import text as X
from skeinlog.functions import times, tools
from skeinlog.plans import unified
from skeinlog.sources import dialect_a as A
from skeinlog.sources import dialect_b as B
from skeinlog.sources import dialect_c as C
from skeinlog.sources import dialect_d as D
from skeinlog.sources import export
from workload import fixture_a, fixture_b, fixture_cd
from workload.area_a import BASE as A_BASE
from workload.area_a import RECORDS as A_RECORDS
from workload.area_a import SESSION_USAGE
from workload.registry import Area
from workload.tables import table

area = Area()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("e"), F.col("event_id").cast("string").alias("id"), "event_type", "value", "ts")


E = "WITH x AS (SELECT event_id, event_id AS e, event_id::VARCHAR AS id, event_type, value, ts FROM events)\n"


@area.query(
    "terminal_cleanup",
    E + "SELECT event_id, CASE WHEN e % 9 = 0 THEN ' Id ok ' || id || chr(10) || '/tmp/app end' WHEN e % 9 = 1 THEN 'error ' || id ELSE 'plain ' || id END AS text FROM x",
)
def terminal_cleanup(spark, sf_dir):
    esc, bel, csi8 = "\x1b", "\x07", "\u009b"
    colored = F.concat(F.lit(f"{esc}[32;1m Id{esc}[0m {esc}[1mok {esc}(B"), "id", F.lit(f"\r\n{esc}]8;;file:///tmp/app{bel}/tmp/app{esc}]8;;{esc}\\ end"))
    # the short escape ESC ( drops one character after ESC, so the charset letter is written before it
    colored = F.replace(colored, F.lit(f"{esc}(B"), F.lit(f"{esc}7"))
    raw = F.when(F.col("e") % 9 == 0, colored).when(F.col("e") % 9 == 1, F.concat(F.lit(f"{csi8}31merror{csi8}0m "), "id")).otherwise(F.concat(F.lit("plain "), "id"))
    return events(spark, sf_dir).select("event_id", X.strip_terminal(raw).alias("text"))


@area.query(
    "utf8_prefixes",
    """SELECT doc_id, n, strlen(t) AS bytes, md5(t) AS digest FROM (SELECT doc_id, n, left(text, list_max(list_filter(range(0, n + 1), lambda k: strlen(left(text, k)) <= n))) AS t
      FROM documents, (VALUES (1), (7), (100), (163)) v(n))""",
)
def utf8_prefixes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(n) for n in (1, 7, 100, 163)])).alias("n"))
    cut = X.cut_bytes(F.col("text"), F.col("n"))
    return rows.select("doc_id", "n", F.octet_length(cut).alias("bytes"), F.md5(F.encode(cut, "UTF-8")).alias("digest"))


@area.query(
    "timestamp_texts",
    E
    + """SELECT event_id, CASE e % 6 WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 3 THEN 'not a time'
      ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS text FROM x""",
)
def timestamp_texts(spark, sf_dir):
    ts, e = F.col("ts"), F.col("e")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    secs = F.unix_timestamp(ts.cast("timestamp"))
    raw = (
        F.when(e % 6 == 0, F.concat(iso, F.lit(".123Z")))
        .when(e % 6 == 1, F.concat(iso, F.lit("+02:00")))
        .when(e % 6 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .when(e % 6 == 3, F.lit("not a time"))
    )
    shown = F.when(e % 6 < 4, times.local_text(raw)).when(e % 6 == 4, times.epoch_text(secs)).otherwise(times.epoch_text(secs * 1000))
    return events(spark, sf_dir).select("event_id", shown.alias("text"))


NAMES = ["Bash", "mcp__srv__do_it", "custom_tool", "", "shell_command", "patch", "Agent", "todowrite", "Glob"]
LABELS = ["Terminal", "srv · do_it", "custom_tool", "Tool", "Terminal", "File patch", "Subagent", "Todo list", "Find files"]


@area.query("tool_labels", E + f"SELECT {LABELS}[(e % 9 + 1)::INT] AS label, count(*) AS calls FROM x GROUP BY 1")
def tool_labels(spark, sf_dir):
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("e") % 9).cast("int"))
    return events(spark, sf_dir).groupBy(tools.tool_label(name).alias("label")).agg(F.count("*").alias("calls"))


@area.query(
    "call_summaries",
    E
    + """SELECT event_id, CASE e % 5 WHEN 0 THEN 'src/f' || id || '.py' WHEN 1 THEN 'ls ' || id WHEN 2 THEN 'https://x/' || id WHEN 3 THEN 'find ' || id END AS summary FROM x""",
)
def call_summaries(spark, sf_dir):
    e = F.col("e")
    field = [
        F.struct(F.concat(F.lit("C:\\w\\src/f"), "id", F.lit(".py")).alias("file_path"), F.lit("ignored").alias("command")),
        F.struct(F.concat(F.lit("ls "), "id", F.lit("\nsecond line")).alias("command"), F.lit("p").alias("prompt")),
        F.struct(F.lit("c").alias("command"), F.concat(F.lit("https://x/"), "id").alias("url")),
        F.struct(F.concat(F.lit("find "), "id").alias("prompt")),
        F.struct(F.lit(1).alias("other")),
    ]
    inp = F.lit(None).cast("string")
    for i, s in enumerate(field):
        inp = F.when(e % 5 == i, F.to_json(s)).otherwise(inp)
    return events(spark, sf_dir).select("event_id", tools.call_summary(inp).alias("summary"))


@area.query(
    "patch_line_classes",
    E
    + """, l AS (SELECT u.k FROM x, LATERAL (VALUES ('marker'), ('file'), ('hunk'), ('add'), ('del'), ('ctx'), ('file'), ('file'), ('marker'), ('file')) u(k))
    SELECT k AS kind, count(*) AS lines FROM l GROUP BY 1""",
)
def patch_line_classes(spark, sf_dir):
    patch = F.concat(
        F.lit("*** Begin Patch\n*** Update File: a"), "id", F.lit("\n@@ x\n+new "), "id", F.lit("\n-old\n ctx\n--- a\n+++ b\n====\nIndex: z")
    )
    rows = events(spark, sf_dir).select(F.explode(F.split(patch, r"\r?\n")).alias("line"))
    return rows.groupBy(X.patch_line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("lines"))


@area.query("todo_progress", E + "SELECT event_id, (e % 2 = 0)::BIGINT AS completed, 1 + (e % 3 = 0)::BIGINT AS in_progress, 1 + (e % 2 <> 0)::BIGINT AS open FROM x")
def todo_progress(spark, sf_dir):
    e = F.col("e")

    def item(status: Column) -> Column:
        return F.struct(F.lit("do").alias("content"), status.alias("status"))

    todos = F.array(
        item(F.when(e % 2 == 0, "completed").otherwise("pending")), item(F.lit("in_progress")), item(F.lit(None).cast("string")),
        item(F.when(e % 3 == 0, "in_progress").otherwise("skip")),
    )
    todos = F.filter(todos, lambda t: ~F.coalesce(t["status"] == "skip", F.lit(False)))
    counts = tools.todo_counts(F.to_json(F.struct(todos.alias("todos"))))
    return events(spark, sf_dir).select("event_id", counts.alias("c")).select("event_id", "c.completed", "c.in_progress", "c.open")


@area.query(
    "result_file_lists",
    "SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '')) AS files FROM documents",
)
def result_file_lists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.file_list(F.col("text"))).alias("files"))


@area.query("separate_stderr", "SELECT doc_id, (NOT contains(text, 'the') AND doc_id % 4 <> 0)::INT AS shown FROM documents")
def separate_stderr(spark, sf_dir):
    stderr = F.when(F.col("doc_id") % 4 != 0, F.lit("the"))
    return table(spark, sf_dir, "documents").select("doc_id", X.separate_stderr(F.col("text"), stderr).cast("int").alias("shown"))


@area.query("fetch_success", E + "SELECT event_id, (e % 5 = 0 OR (e % 600 BETWEEN 200 AND 399))::INT AS ok FROM x")
def fetch_success(spark, sf_dir):
    e = F.col("e")
    return events(spark, sf_dir).select("event_id", X.fetch_ok(F.when(e % 5 != 0, e % 600)).cast("int").alias("ok"))


@area.query(
    "answer_resolution",
    E
    + """SELECT event_id, (e % 4 IN (0, 1))::INT AS yes_selected, CASE e % 4 WHEN 2 THEN 'free ' || id WHEN 3 THEN 'Yes please, No' ELSE '' END AS custom FROM x""",
)
def answer_resolution(spark, sf_dir):
    e = F.col("e")
    answers = F.array(
        F.when(e % 4 == 0, F.lit("Yes")).when(e % 4 == 1, F.lit("Yes, No")).when(e % 4 == 2, F.concat(F.lit("free "), "id")).otherwise("Yes please, No")
    )
    labels = F.array(F.lit("Yes"), F.lit("No"))
    return events(spark, sf_dir).select(
        "event_id", tools.is_selected(answers, F.lit("Yes")).cast("int").alias("yes_selected"), F.array_join(tools.custom_answers(answers, labels), "|").alias("custom")
    )


@area.query(
    "call_parameters",
    """SELECT doc_id, k AS key, v AS value, (length(v) > 80)::INT AS long FROM documents, LATERAL (VALUES ('text', text), ('n', doc_id::VARCHAR), ('flags', '[true,1]')) p(k, v)""",
)
def call_parameters(spark, sf_dir):
    inp = F.concat(F.substring(F.to_json(F.struct("text", F.col("doc_id").alias("n"))), F.lit(1), F.length(F.to_json(F.struct("text", F.col("doc_id").alias("n")))) - 1), F.lit(',"flags":[true,1]}'))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(tools.call_parameters(inp)))
    return rows.select("doc_id", "key", "value", F.col("long").cast("int").alias("long"))


@area.query(
    "front_matter_round_trip",
    "SELECT doc_id, 'name: n' || doc_id AS block, md5(ltrim(text, chr(10))) AS body FROM documents",
)
def front_matter_round_trip(spark, sf_dir):
    block = F.concat(F.lit("  name: n"), F.col("doc_id").cast("string"), F.lit(" \n"))
    joined = M.join_front_matter(block, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", joined.alias("c")).select(
        "doc_id", M.front_matter(F.col("c")).alias("block"), F.md5(F.encode(M.body(F.col("c")), "UTF-8")).alias("body")
    )


# --- result shapes and labels of dialect A ------------------------------------------------------------------


def shaped_lines(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    e = F.col("e")
    return events(spark, sf_dir).select(
        F.concat(F.lit("s"), (e % 50).cast("string")).alias("session_id"), F.floor(e / 4096).cast("bigint").alias("chunk"), e.alias("off"), text.alias("line")
    )


SHAPES = [
    ('{"answers":{"Q":"A@"}}', '{"answers":{"Q":"A@"}}'),
    ('{"code":200,"codeText":"OK","bytes":5,"result":"r@","durationMs":7,"url":"u"}', '{"webfetch":{"code":200,"code_text":"OK","bytes":5,"duration_ms":7,"url":"u"}}'),
    ('{"query":"q@","results":[],"searchCount":2,"durationSeconds":1.5}', '{"websearch":{"count":2,"duration_seconds":1.5}}'),
    ('{"stdout":"o@","stderr":"e@","interrupted":true}', '{"terminal":{"interrupted":true,"background_task_id":null,"exit_note":null,"stderr":"e@"}}'),
    ('{"type":"image","file":{"filePath":"/f@","numLines":3}}', '{"read":{"file_path":"/f@","num_lines":3,"total_lines":null,"start_line":null,"is_image":true}}'),
    ('{"mode":"content","numFiles":1,"appliedLimit":9}', '{"grep":{"mode":"content","num_files":1,"num_lines":null,"truncated":9}}'),
    ('{"filenames":["a@"],"numFiles":4,"truncated":false}', '{"glob":{"num_files":4,"truncated":false}}'),
    ('{"content":[{"type":"text","text":"t@"}]}', None),
]
PREVIEWS = ["", "r@", "", "o@", "", "", "", "t@"]


@area.query(
    "result_shapes",
    E
    + "SELECT e AS unit, CASE e % 8 "
    + " ".join(f"WHEN {i} THEN " + ("NULL" if m is None else "replace('" + m + "', '@', id)") for i, (_, m) in enumerate(SHAPES))
    + " END AS result_meta, CASE e % 8 "
    + " ".join(f"WHEN {i} THEN replace('{p}', '@', id)" for i, p in enumerate(PREVIEWS))
    + " END AS content, CASE WHEN e % 8 = 0 THEN 'content' ELSE 'tool' END AS level, 'tu' || id AS tool_use_id FROM x",
)
def result_shapes(spark, sf_dir):
    body = F.lit(None).cast("string")
    for i, (shape, _) in enumerate(SHAPES):
        body = F.when(F.col("e") % 8 == i, F.replace(F.lit(shape), F.lit("@"), F.col("id"))).otherwise(body)
    line = F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"tu'), "id", F.lit('"}]},"toolUseResult":'), body, F.lit("}"))
    rows = A.records(shaped_lines(spark, sf_dir, line), "tool")
    return rows.select("unit", "result_meta", "content", "level", "tool_use_id")


@area.query(
    "edit_diffs",
    E
    + """SELECT e AS unit, CASE WHEN e % 3 <> 2 THEN '/f' || id END AS file_path, CASE WHEN e % 3 <> 2 THEN 1 ELSE 0 END AS hunks,
      CASE WHEN e % 3 <> 2 THEN '+a' || id || '|-b' END AS lines, CASE WHEN e % 3 <> 2 THEN e % 100 END AS old_start FROM x""",
)
def edit_diffs(spark, sf_dir):
    hunk = F.concat(F.lit('{"oldStart":'), (F.col("e") % 100).cast("string"), F.lit(',"oldLines":1,"newStart":2,"newLines":3,"lines":["+a'), "id", F.lit('","-b"]}'))
    hunks = F.when(F.col("e") % 3 == 2, F.lit("")).when(F.col("e") % 3 == 1, F.concat(hunk, F.lit(',{"oldStart":1}'))).otherwise(hunk)
    line = F.concat(F.lit('{"type":"user","message":{"content":[{"type":"tool_result"}]},"toolUseResult":{"filePath":"/f'), "id", F.lit('","structuredPatch":['), hunks, F.lit("]}}"))
    rows = A.records(shaped_lines(spark, sf_dir, line), "tool")
    d = F.from_json("diff", "file_path string, hunks array<struct<old_start:bigint,old_lines:bigint,new_start:bigint,new_lines:bigint,lines:array<string>>>")
    first = F.get(d["hunks"], F.lit(0))
    return rows.select(
        "unit", d["file_path"].alias("file_path"), F.coalesce(F.size(d["hunks"]), F.lit(0)).alias("hunks"), F.array_join(first["lines"], "|").alias("lines"), first["old_start"].alias("old_start")
    ).withColumn("hunks", F.greatest("hunks", F.lit(0)))


METAS = [
    ('{"type":"ai-title","aiTitle":"T@"}', "session title: T@", "meta"),
    ('{"type":"agent-name","agentName":"N@"}', "current agent: N@", "meta"),
    ('{"type":"attachment","attachment":{"type":"queued_command","prompt":"do @"}}', "queued command: do @", "meta"),
    ('{"type":"attachment","attachment":{"type":"plan_mode_exit"}}', "plan mode left", "meta"),
    ('{"type":"attachment","attachment":{"type":"nested_memory","path":"/m@","content":{"content":"body"}}}', "memory loaded: /m@\n\nbody", "meta"),
    ('{"type":"attachment","attachment":{"type":"task_reminder","itemCount":@}}', "task reminder: @", "meta"),
    ('{"type":"attachment","attachment":{"type":"hook_success","hookEvent":"Stop","stdout":" out @ "}}', "🪝 Stop\nout @", "meta"),
    ('{"type":"attachment","attachment":{"type":"hook_cancelled","hookEvent":"PostToolUse","hookName":"lint","toolUseID":"t@"}}', "🪝 PostToolUse (cancelled) · lint", "hook"),
    ('{"type":"attachment","attachment":{"type":"other_kind"}}', "[attachment: other_kind]", "meta"),
    ('{"type":"mode","mode":"x@"}', 'ⓘ mode\n{"mode":"x@","type":"mode"}', "meta"),
    ('{"type":"attachment","attachment":{"type":"ultra_effort_enter","hookEvent":"E"}}', 'ⓘ attachment · ultra_effort_enter · E\n{"attachment":{"hookEvent":"E","type":"ultra_effort_enter"},"type":"attachment"}', "meta"),
]


def _sql_text(s: str) -> str:
    return "replace('" + s.replace("\n", "' || chr(10) || '") + "', '@', id)" if "\n" not in s else "replace(" + " || chr(10) || ".join(f"'{p}'" for p in s.split("\n")) + ", '@', id)"


@area.query(
    "state_labels",
    E
    + f"SELECT e AS unit, CASE e % {len(METAS)} "
    + " ".join(f"WHEN {i} THEN {_sql_text(m)}" for i, (_, m, _) in enumerate(METAS))
    + f" END AS content, CASE WHEN e % {len(METAS)} = 7 THEN 'hook' ELSE 'meta' END AS record_type FROM x",
)
def state_labels(spark, sf_dir):
    line = F.lit(None).cast("string")
    for i, (raw, _, _) in enumerate(METAS):
        line = F.when(F.col("e") % len(METAS) == i, F.replace(F.lit(raw), F.lit("@"), F.col("id"))).otherwise(line)
    return A.records(shaped_lines(spark, sf_dir, line)).select("unit", "content", "record_type")


@area.query(
    "sidecar_subagents",
    """SELECT 'c' || (conv_id % 5) AS session_id, 'agent-' || conv_id AS agent_id, 'explore' AS agent_type, 'd' || conv_id AS description, 'tu-' || conv_id AS tool_use_id,
      CASE WHEN conv_id % 4 = 0 THEN 0 ELSE greatest(sum(strlen(text)) // 400, 1) END::BIGINT AS record_count FROM conversations GROUP BY conv_id""",
)
def sidecar_subagents(spark, sf_dir):
    conv = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("size"))
    stem = F.concat(F.lit("/h/projects/p/c"), (conv % 5).cast("string"), F.lit("/subagents/agent-"), conv.cast("string"))
    meta = F.to_json(
        F.struct(F.lit("explore").alias("agentType"), F.concat(F.lit("d"), conv.cast("string")).alias("description"), F.concat(F.lit("tu-"), conv.cast("string")).alias("toolUseId"))
    )
    metas = rows.select(F.concat(stem, F.lit(".meta.json")).alias("path"), meta.alias("content"))
    transcripts = rows.where(conv % 4 != 0).select(F.concat(stem, F.lit(".jsonl")).alias("path"), "size")
    return A.sidecar_subagents(metas, transcripts)


# --- export and the union of all sources ---------------------------------------------------------------------


def _export(spark, sf_dir, fmt):
    lines = fixture_a.lines(spark, sf_dir)
    return export.export_rows(A.sessions(lines), A.records(lines, "tool"), fmt, "claude")


EXPORT = (
    A_RECORDS
    + f""", x AS (SELECT *, role = 'assistant' AS used, CASE WHEN role = 'user' AND NOT (noisy AND conv_id % 2 = 0) THEN text END AS prompt FROM b),
  sess AS (SELECT session_id, CASE WHEN conv_id % 7 = 0 THEN 'Title ' || session_id WHEN conv_id % 7 = 3 THEN 'Sum ' || session_id END AS agent_title,
      arg_min(prompt, turn) FILTER (prompt IS NOT NULL) AS first_prompt, min(ts) FILTER (role <> 'system') AS created_at, max(ts) FILTER (role <> 'system') AS updated_at,
      CASE WHEN count(*) FILTER (role = 'user') > 0 THEN '/work/p' || (conv_id % 17) END AS project_path FROM x GROUP BY session_id, conv_id)
"""
)
# calls with their input, which the record rows of the statement do not carry
CALLS = """, calls AS (SELECT session_id, turn*10+1 AS unit, ts, 'Bash' AS tool_name, '{"command":' || to_json(left(text, 20)) || '}' AS input FROM b WHERE tool
  UNION ALL SELECT session_id, turn*10+2, ts, 'Read', '{"file_path":"/work/src/f' || (n % 5) || '.py"}' FROM b WHERE tool AND conv_id % 3 = 0)
"""
ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@area.query(
    "export_markdown",
    EXPORT
    + CALLS
    + """SELECT session_id, unit, 2 AS seq, '### 🔧 ' || tool_name || chr(10) || chr(10) || '```json' || chr(10) || input || chr(10) || '```' || chr(10) AS text FROM calls
    UNION ALL SELECT session_id, unit, seq, CASE WHEN record_type = 'user' THEN '## 🧑 User' || chr(10) || chr(10) || content || chr(10)
        WHEN record_type = 'assistant' THEN '## 🤖 Assistant' || chr(10) || chr(10) || content || chr(10)
        WHEN record_type = 'thinking' THEN '> 💭 ' || replace(content, chr(10), chr(10) || '> ') || chr(10)
        WHEN record_type = 'tool_result' THEN '```' || chr(10) || content || chr(10) || '```' || chr(10)
        ELSE '_' || record_type || '_: ' || content || chr(10) END AS text FROM r WHERE level <> 'debug' AND content <> ''
    UNION ALL SELECT session_id, -1, 0, '# ' || coalesce(agent_title, first_prompt, project_path, session_id) || chr(10) || chr(10) || '- Source: claude' || chr(10) ||
      '- Project: ' || coalesce(project_path, '') || coalesce(chr(10) || '- Agent title: ' || agent_title, '') || coalesce(chr(10) || '- Created: ' || created_at, '') ||
      coalesce(chr(10) || '- Updated: ' || updated_at, '') || chr(10) FROM sess""",
)
def export_markdown(spark, sf_dir):
    return _export(spark, sf_dir, "md")


@area.query(
    "export_html",
    EXPORT
    + CALLS
    + f"""SELECT session_id, unit, 2 AS seq, '<div class="msg tool"><div class="role">🔧 ' || tool_name || '</div><pre>' || {ESC.format('input')} || '</pre></div>' AS text FROM calls
    UNION ALL SELECT session_id, unit, seq, '<div class="msg ' || s || '"><div class="role">' || h || '</div>' ||
        CASE WHEN s IN ('user', 'assistant') THEN '<div class="ts">' || ts || '</div>' ELSE '' END || '<pre>' || {ESC.format('content')} || '</pre></div>' AS text
      FROM (SELECT *, CASE record_type WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'thinking' THEN 'think' WHEN 'tool_result' THEN 'result' ELSE 'other' END AS s,
        CASE record_type WHEN 'user' THEN '🧑 User' WHEN 'assistant' THEN '🤖 Assistant' WHEN 'thinking' THEN '💭 Thinking' WHEN 'tool_result' THEN '↳ Result' ELSE record_type END AS h
        FROM r WHERE level <> 'debug' AND content <> '')
    UNION ALL SELECT session_id, -1, 0, '<h1>' || {ESC.format('coalesce(agent_title, first_prompt, project_path, session_id)')} || '</h1><div class="meta">claude · ' ||
      coalesce(project_path, '') || coalesce(' · Updated ' || updated_at, '') || '</div>' FROM sess""",
)
def export_html(spark, sf_dir):
    return _export(spark, sf_dir, "html")


@area.query(
    "export_json",
    EXPORT
    + """SELECT session_id, unit, seq, record_type, content AS content_preview, ts AS timestamp, tool_name, NULL AS agent_title, NULL AS first_prompt FROM r WHERE level <> 'debug'
    UNION ALL SELECT session_id, -1, 0, NULL, NULL, NULL, NULL, agent_title, first_prompt FROM sess""",
)
def export_json(spark, sf_dir):
    rows = _export(spark, sf_dir, "json")
    parsed = F.from_json("text", "record_type string, content_preview string, timestamp string, tool_name string, agent_title string, first_prompt string")
    return rows.select("session_id", "unit", "seq", parsed.alias("p")).select("session_id", "unit", "seq", "p.*")


@area.query(
    "all_source_usage",
    A_BASE
    + f""", x AS (SELECT *, role = 'assistant' AS used FROM b),
    ev AS (SELECT event_id AS e, event_id % 3 <> 0 AS sub, CAST(ROUND(value*100) AS BIGINT) AS c FROM events),
    evu AS (SELECT *, c + 100 + e % 13 AS ti, c % 11 + 5 AS t_o, c % 7 + 1 AS tc, CASE WHEN e % 23 = 4 THEN 1 ELSE c + c % 11 + 135 END AS tt FROM ev),
    evo AS (SELECT *, sub AND e % 4 <> 1 AND tt >= c + c % 11 AS s FROM evu)
    SELECT 'claude' AS source, {SESSION_USAGE} FROM x
    UNION ALL SELECT 'codex', sum(CASE WHEN s THEN greatest(ti - c, 0) ELSE ti END)::BIGINT, sum(CASE WHEN s THEN greatest(t_o - c % 11, 0) ELSE t_o END)::BIGINT,
      sum(CASE WHEN s THEN greatest(tc - c % 7, 0) ELSE tc END)::BIGINT, sum(CASE WHEN s THEN greatest(tt - c - c % 11, 0) ELSE tt END)::BIGINT FROM evo
    UNION ALL SELECT 'opencode', sum(n)::BIGINT, sum(turn + n % 5)::BIGINT, sum(n % 7 + n % 3)::BIGINT, sum(n + turn + n % 5 + n % 7 + n % 3)::BIGINT FROM b WHERE role = 'assistant'
    UNION ALL SELECT 'pi', sum(CASE WHEN used THEN n WHEN role = 'system' THEN 5 ELSE 0 END)::BIGINT, sum(CASE WHEN used THEN turn WHEN role = 'system' THEN 2 ELSE 0 END)::BIGINT,
      sum(CASE WHEN used THEN n % 7 + n % 3 ELSE 0 END)::BIGINT,
      sum(CASE WHEN used AND conv_id % 2 = 0 THEN n + turn WHEN used THEN n + turn + n % 7 + n % 3 WHEN role = 'system' THEN 7 ELSE 0 END)::BIGINT FROM x WHERE conv_id % 9 <> 8""",
)
def all_source_usage(spark, sf_dir):
    """One relation over all four dialects, rolled up by source."""
    src_b = fixture_b.lines(spark, sf_dir)
    threads = B.own_usage(src_b, B.identities(src_b))
    sessions, parts = fixture_cd.c_sessions(spark, sf_dir), fixture_cd.c_parts(spark, sf_dir)
    all_rows = unified.union_sources(
        {
            A.SOURCE: A.sessions(fixture_a.lines(spark, sf_dir)),
            B.SOURCE: threads,
            C.SOURCE: C.usage(parts, C.roots(sessions)),
            D.SOURCE: D.sessions(fixture_cd.d_lines(spark, sf_dir)),
        }
    )
    return unified.usage_by_source(all_rows)
