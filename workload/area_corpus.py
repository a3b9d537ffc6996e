"""Markdown corpora, tool configs, inventories, manifests and incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.plans import incremental as R
from skeinlog.plans import inventory as V
from skeinlog.session import scratch_path
from skeinlog.sources import configs, corpus, files
from workload.registry import Area
from workload.tables import table

area = Area()

# --- Markdown ------------------------------------------------------------------------------------------


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    s = d.cast("string")
    kind = d % 5
    nl = "\n"
    path = (
        F.when(d % 50 == 0, F.concat(F.lit("/h/projects/-work-p"), (d % 7).cast("string"), F.lit("-"), s, F.lit("/memory/MEMORY.md")))
        .when(kind < 2, F.concat(F.lit("/h/projects/-work-p"), (d % 7).cast("string"), F.lit("/memory/m"), s, F.lit(".md")))
        .when(kind == 2, F.concat(F.lit("/h/rules/"), F.when(d % 4 == 0, "_disabled/").otherwise(""),
                                  F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("cat"), (d % 3).cast("string"), F.lit("/"))), F.lit("r"), s, F.lit(".md")))
        .when(kind == 3, F.concat(F.lit("/h/skills/s"), s, F.lit("/SKILL.md")))
        .otherwise(F.concat(F.lit("/h/"), F.get(F.array(F.lit("commands"), F.lit("plans"), F.lit("tasks")), (d % 3).cast("int")), F.lit("/x"), s, F.lit(".md")))
    )
    head = F.concat(F.lit(f'---{nl}name: "Name '), s, F.lit(f'"{nl}description: Desc '), s, F.lit(nl))
    content = (
        F.when(d % 50 == 0, F.col("text"))
        .when(kind == 0, F.concat(head, F.lit(f"type: t"), (d % 3).cast("string"), F.lit(f"{nl}---{nl}{nl}"), "text"))
        .when(kind == 1, F.concat(head, F.lit(f"metadata:{nl}  extra: 1{nl}  type: nested{nl}---{nl}"), "text"))
        .when(kind == 2, F.concat(head, F.lit("globs: '*.py'\nalwaysApply: "), F.when(d % 2 == 0, "true").otherwise("false"), F.lit(f"{nl}---{nl}"), "text"))
        .when(kind == 3, F.concat(head, F.lit(f"---{nl}"), "text"))
        .otherwise(F.concat(F.lit("# Heading\n\n  "), "text"))
    )
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"))
    return rows.withColumn("size_bytes", F.octet_length("content").cast("bigint"))


MEMORIES = """WITH m AS (
  SELECT doc_id AS d, CASE WHEN doc_id % 50 = 0 THEN '-work-p' || (doc_id % 7) || '-' || doc_id ELSE '-work-p' || (doc_id % 7) END AS project,
    CASE WHEN doc_id % 50 = 0 THEN 'MEMORY.md' ELSE 'm' || doc_id || '.md' END AS filename,
    CASE WHEN doc_id % 50 = 0 THEN 'MEMORY.md' ELSE 'Name ' || doc_id END AS name, CASE WHEN doc_id % 50 <> 0 THEN 'Desc ' || doc_id END AS description,
    CASE WHEN doc_id % 50 = 0 THEN 'index' WHEN doc_id % 5 = 0 THEN 't' || (doc_id % 3) ELSE 'nested' END AS memory_type, text
  FROM documents WHERE doc_id % 5 < 2)
"""


@area.query(
    "memory_inventory",
    MEMORIES + "SELECT project, '/' || replace(project, '-', '/') AS project_path, filename, name, description, memory_type, md5(ltrim(text, chr(10))) AS body FROM m",
)
def memory_inventory(spark, sf_dir):
    rows = corpus.memories(markdown_files(spark, sf_dir))
    return rows.select("project", "project_path", "filename", "name", "description", "memory_type", F.md5(F.encode("body", "UTF-8")).alias("body"))


@area.query("memory_type_counts", MEMORIES + "SELECT memory_type, count(*) AS memories FROM m GROUP BY 1")
def memory_type_counts(spark, sf_dir):
    return corpus.type_counts(corpus.memories(markdown_files(spark, sf_dir)))


@area.query(
    "memory_filter",
    MEMORIES + "SELECT filename, name FROM m WHERE memory_type = 'nested' AND (contains(lower(name), '7') OR contains(lower(description), '7') OR contains(filename, '7'))",
)
def memory_filter(spark, sf_dir):
    return corpus.matching_memories(corpus.memories(markdown_files(spark, sf_dir)), "nested", "7").select("filename", "name")


@area.query(
    "rule_inventory",
    """SELECT CASE WHEN doc_id % 3 = 0 THEN 'root' ELSE 'cat' || (doc_id % 3) END AS category, 'r' || doc_id || '.md' AS filename,
    (doc_id % 4 <> 0)::INT AS enabled, 'Desc ' || doc_id AS description, '*.py' AS globs, (doc_id % 2 = 0)::INT AS always_apply
    FROM documents WHERE doc_id % 5 = 2""",
)
def rule_inventory(spark, sf_dir):
    rows = corpus.rules(markdown_files(spark, sf_dir))
    return rows.select(
        F.regexp_replace("category", "/$", "").alias("category"), "filename", F.col("enabled").cast("int").alias("enabled"), "description", "globs",
        F.col("always_apply").cast("int").alias("always_apply"),
    )


WORKFLOWS = """WITH w AS (
  SELECT 'skill' AS kind, 's' || doc_id AS name, 'Desc ' || doc_id AS description FROM documents WHERE doc_id % 5 = 3
  UNION ALL SELECT ['command', 'plan', 'task'][doc_id % 3 + 1], 'x' || doc_id, CASE WHEN length(l) > 160 THEN left(l, 160) || '…' ELSE coalesce(l, '') END
  FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '' AND NOT starts_with(t, '#'))[1] AS l
        FROM documents WHERE doc_id % 5 = 4))
"""


@area.query("workflow_inventory", WORKFLOWS + "SELECT kind, name, description FROM w")
def workflow_inventory(spark, sf_dir):
    return corpus.workflows(markdown_files(spark, sf_dir)).select("kind", "name", "description").orderBy("kind", "name")


@area.query("workflow_kind_counts", WORKFLOWS + "SELECT kind, count(*) AS workflows FROM w GROUP BY 1")
def workflow_kind_counts(spark, sf_dir):
    return corpus.kind_counts(corpus.workflows(markdown_files(spark, sf_dir)))


@area.query(
    "workflow_filter",
    """WITH w AS (
      SELECT 'skill' AS kind, 's' || doc_id AS name, 'Desc ' || doc_id AS whole FROM documents WHERE doc_id % 5 = 3
      UNION ALL SELECT ['command', 'plan', 'task'][doc_id % 3 + 1], 'x' || doc_id,
        coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '' AND NOT starts_with(t, '#'))[1], '') FROM documents WHERE doc_id % 5 = 4)
    SELECT kind, name FROM w WHERE kind = 'plan' AND (contains(lower(name), '9') OR contains(lower(whole), '9'))""",
)
def workflow_filter(spark, sf_dir):
    """Looks for the text in whole descriptions, also behind the 160 characters that lists show."""
    return corpus.matching_workflows(corpus.workflows(markdown_files(spark, sf_dir)), "plan", "9").select("kind", "name")


# --- tool configs --------------------------------------------------------------------------------------

JSON_CONFIG = (
    '{"mcpServers":{"fs":{"command":"npx","args":["a","b",3],"env":{"K":"secret","L":"s2"}},"remote":{"url":"https://x/@","enabled":false},"odd":{}},'
    '"projects":{"/work/p@":{"mcpServers":{"p":{"type":"sse","url":"u@"}}}},'
    '"hooks":{"PreToolUse":[{"matcher":"Bash","hooks":[{"command":"echo @"},{"command":"two"}]},{"hooks":[]}]}}'
)
TOML_CONFIG = r"""notify = ["bash", "-c", "echo #@"] # note
[mcp_servers.alpha]
command = "npx" # run
args = ["-y", "pkg,@", 'C:\x', "q\"q"]

[mcp_servers.alpha.env]
API_KEY = "secret"
TOKEN = "x"
API_KEY = "again"
[mcp_servers."web-@"]
url = "https://h/@#frag"
[other]
x = 1
"""
JSONC_CONFIG = """{ // "mcp" comes next
  "mcp": { "a": {"command": ["run", "--k", "@"], "environment": {"B": "1", "A": "2"}, "headers": {"A": "3"}}, /* block "x" */
    "web": {"type": "remote", "url": "https://x//@", "enabled": false} }
}
"""


def _configs(spark: SparkSession, sf_dir: str, template: str, name: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("/home/u"), k, F.lit(f"/{name}")).alias("path"), F.lit("global").alias("scope"), F.replace(F.lit(template), F.lit("@"), k).alias("content")
    )


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "path", "scope", "name", "transport", "command", F.array_join("args", "|").alias("args"), F.array_join("env_keys", "|").alias("env_keys"),
        F.col("enabled").cast("int").alias("enabled"),
    )


@area.query(
    "json_tool_servers",
    """SELECT '/home/u' || c_custkey || '/a.json' AS path, s AS scope, n AS name, t AS transport, c AS command, a AS args, e AS env_keys, en AS enabled
    FROM customer, LATERAL (VALUES ('global', 'fs', 'stdio', 'npx', 'a|b', 'K|L', 1), ('global', 'remote', 'http', 'https://x/' || c_custkey, '', '', 0),
      ('global', 'odd', 'unknown', '', '', '', 1), ('/work/p' || c_custkey, 'p', 'sse', 'u' || c_custkey, '', '', 1)) v(s, n, t, c, a, e, en)""",
)
def json_tool_servers(spark, sf_dir):
    return _shown(configs.json_servers(_configs(spark, sf_dir, JSON_CONFIG, "a.json")))


@area.query(
    "json_tool_hooks",
    """SELECT '/home/u' || c_custkey || '/a.json' AS path, 'PreToolUse' AS event, m AS matcher, c AS commands
    FROM customer, LATERAL (VALUES ('Bash', 'echo ' || c_custkey || '|two'), ('', '')) v(m, c)""",
)
def json_tool_hooks(spark, sf_dir):
    rows = configs.json_hooks(_configs(spark, sf_dir, JSON_CONFIG, "a.json"))
    return rows.select("path", "event", "matcher", F.array_join("commands", "|").alias("commands"))


@area.query(
    "toml_tool_servers",
    """SELECT '/home/u' || c_custkey || '/c.toml' AS path, 'global · wsl' AS scope, n AS name, t AS transport, c AS command, a AS args, e AS env_keys, 1 AS enabled
    FROM customer, LATERAL (VALUES ('alpha', 'stdio', 'npx', '-y|pkg,' || c_custkey || '|C:\\x|q"q', 'API_KEY|TOKEN'),
      ('web-' || c_custkey, 'http', 'https://h/' || c_custkey || '#frag', '', '')) v(n, t, c, a, e)""",
)
def toml_tool_servers(spark, sf_dir):
    return _shown(configs.host_tagged(configs.toml_servers(_configs(spark, sf_dir, TOML_CONFIG, "c.toml")), "wsl"))


@area.query(
    "toml_tool_hooks",
    "SELECT '/home/u' || c_custkey || '/c.toml' AS path, 'notify' AS event, 'bash|-c|echo #' || c_custkey AS commands FROM customer",
)
def toml_tool_hooks(spark, sf_dir):
    rows = configs.toml_hooks(_configs(spark, sf_dir, TOML_CONFIG, "c.toml"))
    return rows.select("path", "event", F.array_join("commands", "|").alias("commands"))


@area.query(
    "jsonc_tool_servers",
    """SELECT '/home/u' || c_custkey || '/o.jsonc' AS path, 'global' AS scope, n AS name, t AS transport, c AS command, a AS args, e AS env_keys, en AS enabled
    FROM customer, LATERAL (VALUES ('a', 'stdio', 'run', '--k|' || c_custkey, 'A|B', 1), ('web', 'http', 'https://x//' || c_custkey, '', '', 0)) v(n, t, c, a, e, en)""",
)
def jsonc_tool_servers(spark, sf_dir):
    return _shown(configs.jsonc_servers(_configs(spark, sf_dir, JSONC_CONFIG, "o.jsonc")))


# --- files, projects, storage ----------------------------------------------------------------------------


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata derived from ``documents``: session and memory files of several projects and snapshots."""
    d = F.col("doc_id")
    s = d.cast("string")
    root = F.when(d % 10 == 9, F.concat(F.lit("/h/archives/snap-"), (d % 3).cast("string"))).otherwise("/h/live")
    name = F.when(d % 4 == 0, F.concat(F.lit("memory/m"), s, F.lit(".md"))).otherwise(F.concat(F.lit("s"), s, F.lit(".jsonl")))
    return table(spark, sf_dir, "documents").select(
        F.concat_ws("/", root, F.lit("projects"), F.concat(F.lit("-w-p"), (d % 13).cast("string")), name).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.timestamp_seconds(F.lit(1_767_225_600) + (d * 37) % 100_000).alias("mtime"),
        d.alias("doc_id"),
    )


LISTING = """WITH l AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'snap-' || (doc_id % 3) END AS archive,
    CASE WHEN doc_id % 10 = 9 THEN '/h/archives/snap-' || (doc_id % 3) ELSE '/h/live' END || '/projects/-w-p' || (doc_id % 13) || '/' ||
    CASE WHEN doc_id % 4 = 0 THEN 'memory/m' || doc_id || '.md' ELSE 's' || doc_id || '.jsonl' END AS path,
    strlen(text) AS size, 1767225600 + (doc_id * 37) % 100000 AS secs FROM documents)
"""


@area.query(
    "project_inventory",
    LISTING
    + """SELECT '-w-p' || (doc_id % 13) AS slug, '//w/p' || (doc_id % 13) AS display_path, count(*) FILTER (doc_id % 4 = 0) AS memory_count,
    count(*) FILTER (doc_id % 4 <> 0) AS session_count, strftime(to_timestamp(max(secs) FILTER (doc_id % 4 <> 0)), '%Y-%m-%d %H:%M:%S') AS last_active FROM l GROUP BY doc_id % 13""",
)
def project_inventory(spark, sf_dir):
    rows = V.projects(listing(spark, sf_dir))
    return rows.select("slug", "display_path", "memory_count", "session_count", F.date_format("last_active", "yyyy-MM-dd HH:mm:ss").alias("last_active"))


@area.query("file_manifest", LISTING + "SELECT path AS key, size || ':' || secs AS version FROM l")
def file_manifest(spark, sf_dir):
    return files.manifest(listing(spark, sf_dir))


@area.query(
    "group_manifest",
    LISTING + "SELECT '-w-p' || (doc_id % 13) || '/' || (doc_id // 100) AS key, count(*) || ':' || sum(('0x' || substr(md5(path || '@' || size || ':' || secs), 1, 12))::BIGINT) AS version FROM l GROUP BY 1",
)
def group_manifest(spark, sf_dir):
    rows = listing(spark, sf_dir)
    key = F.concat(F.lit("-w-p"), (F.col("doc_id") % 13).cast("string"), F.lit("/"), F.floor(F.col("doc_id") / 100).cast("string"))
    members = rows.select(key.alias("root_key"), F.col("path"), F.concat_ws(":", F.col("size").cast("string"), F.unix_timestamp("mtime").cast("string")).alias("version"))
    return files.group_manifest(members)


@area.query("archive_tags", LISTING + "SELECT coalesce(archive, '') AS archive, count(*) AS files FROM l GROUP BY 1")
def archive_tags(spark, sf_dir):
    archive = F.coalesce(files.archive_of(F.col("path")), F.lit(""))
    return listing(spark, sf_dir).groupBy(archive.alias("archive")).agg(F.count("*").alias("files"))


@area.query(
    "storage_stats",
    LISTING
    + """SELECT tree, count(*) AS files, sum(size)::BIGINT AS bytes, CASE WHEN sum(size) >= 1073741824 THEN printf('%.1f GB', sum(size) / 1073741824.0)
      WHEN sum(size) >= 1048576 THEN printf('%.1f MB', sum(size) / 1048576.0)
      WHEN sum(size) >= 1024 THEN printf('%.1f KB', sum(size) / 1024.0) ELSE sum(size) || ' B' END AS size_human
    FROM (SELECT coalesce(archive, 'live') AS tree, size, path FROM l) WHERE NOT starts_with(path, '/h/live/projects/-w-p3/') GROUP BY 1""",
)
def storage_stats(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumn("tree", F.coalesce(files.archive_of(F.col("path")), F.lit("live")))
    return V.storage_stats(rows, ["/h/live/projects/-w-p3"])


@area.query(
    "snapshot_list",
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'auto-' ELSE 'snap-' END || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2026-01-01' END AS created,
      CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 9 END AS items, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS total_size,
      CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '1 B' END AS size_human, CASE WHEN doc_id % 3 = 1 THEN 'n' || doc_id END AS note, (doc_id % 2 = 0)::INT AS is_auto FROM documents""",
)
def snapshot_list(spark, sf_dir):
    d = F.col("doc_id")
    content = F.when(
        d % 3 != 0,
        F.to_json(F.struct(F.lit("2026-01-01").alias("created"), (d % 9).alias("items"), F.col("n_chars").alias("total_size"), F.lit("1 B").alias("size_human"),
                           F.when(d % 3 == 1, F.concat(F.lit("n"), d.cast("string"))).alias("note"))),
    ).otherwise(F.when(d % 2 == 0, F.lit("{broken")))
    metas = table(spark, sf_dir, "documents").select(
        F.concat(F.when(d % 2 == 0, "auto-").otherwise("snap-"), d.cast("string")).alias("name"), content.alias("content")
    )
    return V.snapshots(metas).withColumn("is_auto", F.col("is_auto").cast("int"))


ROOTS = "unnest(['/work/p' || (doc_id % 17), CASE WHEN doc_id % 5 = 0 THEN 'global' END, CASE WHEN doc_id % 7 = 0 THEN ' /data/d' || (doc_id % 3) || ' ' END, CASE WHEN doc_id % 11 = 0 THEN 'rel/x' END])"


@area.query("project_roots", f"SELECT DISTINCT trim(r) AS root FROM (SELECT {ROOTS} AS r FROM documents) WHERE starts_with(trim(r), '/')")
def project_roots(spark, sf_dir):
    d = F.col("doc_id")
    paths = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/work/p"), (d % 17).cast("string")).alias("directory"),
        F.when(d % 5 == 0, "global").alias("project_id"),
        F.when(d % 7 == 0, F.concat(F.lit(" /data/d"), (d % 3).cast("string"), F.lit(" "))).alias("other"),
        F.when(d % 11 == 0, "rel/x").alias("path"),
    )
    return V.project_roots(paths)


def _artifact_inputs(spark: SparkSession, sf_dir: str):
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    source = F.get(F.array(F.lit("claude"), F.lit("codex"), F.lit("opencode")), (d % 3).cast("int"))
    roots = docs.select(source.alias("source"), F.concat(F.lit("/work/p"), F.floor(d / 2).cast("string")).alias("root"))
    name = F.when(d % 4 < 2, F.when(d % 3 == 0, "CLAUDE.md").otherwise("AGENTS.md")).when(d % 4 == 2, ".codex/config.toml").otherwise("opencode.jsonc")
    existing = docs.select(F.concat(F.lit("/work/p"), F.floor(d / 2).cast("string"), F.lit("/"), name).alias("path"), F.col("n_chars").alias("size"))
    return roots, existing.groupBy("path").agg(F.max("size").alias("size"))


ARTIFACTS = """WITH root AS (SELECT DISTINCT ['claude', 'codex', 'opencode'][doc_id % 3 + 1] AS source, '/work/p' || (doc_id // 2) AS root FROM documents),
cand(source, file, kind) AS (VALUES ('claude', 'CLAUDE.md', 'instructions'), ('codex', 'AGENTS.md', 'instructions'), ('codex', '.codex/config.toml', 'config'),
  ('opencode', 'AGENTS.md', 'instructions'), ('opencode', 'opencode.json', 'config'), ('opencode', 'opencode.jsonc', 'config')),
ex AS (SELECT '/work/p' || (doc_id // 2) || '/' || CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'CLAUDE.md' ELSE 'AGENTS.md' END
    WHEN doc_id % 4 = 2 THEN '.codex/config.toml' ELSE 'opencode.jsonc' END AS path, max(n_chars) AS size FROM documents GROUP BY 1),
art AS (SELECT root.source, root.root, root.root || '/' || file AS path, kind, (ex.path IS NOT NULL)::INT AS "exists", coalesce(size, 0) AS size_bytes
  FROM root JOIN cand USING (source) LEFT JOIN ex ON ex.path = root.root || '/' || file)
"""


@area.query("instruction_artifacts", ARTIFACTS + 'SELECT source, path, kind, "exists", size_bytes FROM art')
def instruction_artifacts(spark, sf_dir):
    rows = V.instruction_artifacts(*_artifact_inputs(spark, sf_dir), include_missing=True)
    return rows.select("source", "path", "kind", F.col("exists").cast("int").alias("exists"), "size_bytes")


@area.query(
    "project_context",
    ARTIFACTS
    + """, rules AS (SELECT ['claude', 'codex', 'opencode'][doc_id % 3 + 1] AS source, '/work/P' || (doc_id // 2) || '/' AS category,
        '/work/p' || (doc_id // 2) || '/' || CASE WHEN doc_id % 4 < 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'CLAUDE.md' ELSE 'AGENTS.md' END ELSE 'r' || doc_id || '.md' END AS path FROM documents),
    mem AS (SELECT ['claude', 'codex', 'opencode'][doc_id % 3 + 1] AS source, CASE WHEN doc_id % 2 = 0 THEN 'slug' || (doc_id // 2) ELSE 'else' END AS slug,
        CASE WHEN doc_id % 4 = 1 THEN '\\WORK\\p' || (doc_id // 2) ELSE '/x' END AS mpath, 'f' || doc_id AS filename FROM documents)
    SELECT source, 'slug' || substr(root, 8) AS project, root AS project_path,
      (SELECT count(*) FROM art a WHERE a.source = r.source AND a.root = r.root AND a."exists" = 1) AS instructions,
      (SELECT count(*) FROM rules u WHERE u.source = r.source AND lower(rtrim(category, '/')) = lower(root)
         AND path NOT IN (SELECT path FROM art a WHERE a.source = r.source AND a."exists" = 1)) AS rules,
      (SELECT count(DISTINCT (slug, filename)) FROM mem m WHERE m.source = r.source AND (slug = 'slug' || substr(root, 8) OR lower(replace(mpath, '\\', '/')) = lower(root))) AS memories
    FROM root r""",
)
def project_context(spark, sf_dir):
    roots, existing = _artifact_inputs(spark, sf_dir)
    artifacts = V.instruction_artifacts(roots, existing)
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    source = F.get(F.array(F.lit("claude"), F.lit("codex"), F.lit("opencode")), (d % 3).cast("int")).alias("source")
    half = F.floor(d / 2).cast("string")
    rule_name = F.when(d % 4 < 2, F.when(d % 3 == 0, "CLAUDE.md").otherwise("AGENTS.md")).otherwise(F.concat(F.lit("r"), d.cast("string"), F.lit(".md")))
    rules = docs.select(source, F.concat(F.lit("/work/P"), half, F.lit("/")).alias("category"), F.concat(F.lit("/work/p"), half, F.lit("/"), rule_name).alias("path"))
    memories = docs.select(
        source,
        F.when(d % 2 == 0, F.concat(F.lit("slug"), half)).otherwise("else").alias("project"),
        F.when(d % 4 == 1, F.concat(F.lit("\\WORK\\p"), half)).otherwise("/x").alias("project_path"),
        F.concat(F.lit("f"), d.cast("string")).alias("filename"),
    )
    projects = roots.distinct().select("source", F.concat(F.lit("slug"), F.substring("root", 8, 100)).alias("project"), F.col("root").alias("project_path"))
    return V.project_context(projects, artifacts, rules, memories)


# --- line scan and hosts -----------------------------------------------------------------------------------


@area.query(
    "line_byte_offsets",
    """WITH l AS (SELECT doc_id // 50 AS shard, doc_id, u.i, u.t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) x,
      LATERAL (SELECT unnest(l) AS t, generate_subscripts(l, 1) AS i) u),
    o AS (SELECT shard, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY shard ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, t FROM l)
    SELECT shard, off, strlen(t) AS bytes, md5(t) AS digest FROM o""",
)
def line_byte_offsets(spark, sf_dir):
    """Texts written as line files, then scanned with their byte offsets."""
    root = scratch_path(spark, "lines")
    shard = F.floor(F.col("doc_id") / 50).cast("bigint")
    rows = table(spark, sf_dir, "documents").select(shard.alias("shard"), "doc_id", F.col("text").alias("value"))
    rows.repartition("shard").sortWithinPartitions("shard", "doc_id").drop("doc_id").write.partitionBy("shard").text(root)
    scanned = files.scan_lines(spark, root, "*.txt")
    return scanned.select(
        F.regexp_extract("file_path", r"shard=(\d+)/", 1).cast("bigint").alias("shard"), "off", F.octet_length("line").alias("bytes"),
        F.md5(F.encode("line", "UTF-8")).alias("digest"),
    )


@area.query(
    "host_tagged_union",
    LISTING
    + """SELECT coalesce(h, '') AS host, CASE WHEN h IS NULL THEN path ELSE '@wsl:' || h || '/' || path END AS key,
      CASE WHEN archive IS NULL THEN '' WHEN h IS NULL THEN archive ELSE '@wsl:' || h || '/' || archive END AS archive_name FROM l, (VALUES (NULL), ('Ubuntu')) v(h)""",
)
def host_tagged_union(spark, sf_dir):
    rows = listing(spark, sf_dir).select(F.col("path").alias("key"), files.archive_of(F.col("path")).alias("archive_name"))
    both = files.host_union([(None, rows), ("Ubuntu", rows)])
    return both.select(F.coalesce("host", F.lit("")).alias("host"), "key", F.coalesce("archive_name", F.lit("")).alias("archive_name"))


@area.query(
    "host_key_round_trip",
    """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Ubuntu' END AS host, CASE WHEN doc_id % 3 = 2 THEN 'me' END AS "user", 'k/' || doc_id AS key FROM documents""",
)
def host_key_round_trip(spark, sf_dir):
    d = F.col("doc_id")
    host, user = F.when(d % 3 > 0, "Ubuntu"), F.when(d % 3 == 2, "me")
    tagged = X.tag_key(host, user, F.concat(F.lit("k/"), d.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", tagged.alias("t")).select("doc_id", X.split_key(F.col("t")).alias("k")).select(
        "doc_id", "k.host", "k.user", "k.key"
    )


@area.query(
    "comparable_paths",
    """SELECT doc_id, '/work/p' || doc_id AS path, CASE WHEN doc_id % 2 = 0 THEN 'Deb' || doc_id END AS host FROM documents""",
)
def comparable_paths(spark, sf_dir):
    d = F.col("doc_id")
    s = d.cast("string")
    unc = F.concat(F.lit("\\\\WSL.localhost\\Deb"), s, F.lit("\\home"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.comparable_path(F.concat(F.lit("\\Work\\P"), s, F.lit("\\/"))).alias("path"),
        X.host_of_path(F.when(d % 2 == 0, unc).otherwise("/home/me")).alias("host"),
    )


# --- incremental refresh --------------------------------------------------------------------------------------


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.lit("claude").alias("source"), F.concat(F.lit("d"), d.cast("string")).alias("key"), "doc_id", F.lit("1").alias("v"))
    previous = base.where(d % 13 != 0).select("source", "key", F.col("v").alias("version"))
    current = base.where(d % 11 != 0).select("source", "key", F.when(d % 7 == 0, "2").otherwise("1").alias("version"))
    return previous, current


DIFF = """WITH d AS (SELECT 'd' || doc_id AS key, doc_id % 13 <> 0 AS was, doc_id % 11 <> 0 AS now, doc_id % 7 = 0 AS bumped, text FROM documents)
"""


@area.query(
    "manifest_diff",
    DIFF + "SELECT key, CASE WHEN NOT was THEN 'new' WHEN NOT now THEN 'deleted' WHEN bumped THEN 'changed' ELSE 'unchanged' END AS status FROM d WHERE was OR now",
)
def manifest_diff(spark, sf_dir):
    return R.manifest_diff(*manifests(spark, sf_dir)).select("key", "status")


@area.query(
    "incremental_merge",
    DIFF + "SELECT key, CASE WHEN NOT was OR bumped THEN 'fresh' ELSE 'kept' END AS origin, length(text) AS chars FROM d WHERE now",
)
def incremental_merge(spark, sf_dir):
    previous, current = manifests(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("key"), F.length("text").alias("chars"))
    stored = previous.select("source", "key").join(docs, "key").withColumn("origin", F.lit("kept"))
    stale = R.stale_keys(R.manifest_diff(previous, current))
    parsed = stale.join(docs, "key").withColumn("origin", F.lit("fresh"))
    return R.merge(stored, parsed.select(stored.columns), current).select("key", "origin", "chars")


@area.query(
    "change_fingerprint",
    LISTING + "SELECT count(*) AS files, strftime(to_timestamp(max(secs)), '%Y-%m-%d %H:%M:%S') AS latest, 1 AS move_detected, 1 AS stable FROM l",
)
def change_fingerprint(spark, sf_dir):
    """A moved file keeps its size and time, yet changes the mark; the same files give the same mark."""
    rows = listing(spark, sf_dir)
    moved = rows.withColumn("path", F.when(F.col("doc_id") == 3, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")))
    again = rows.repartition(5)
    marks = R.fingerprint(rows).withColumn("side", F.lit("a"))
    for name, other in (("b", moved), ("c", again)):
        marks = marks.unionByName(R.fingerprint(other).withColumn("side", F.lit(name)))

    def of(side: str):
        return F.max(F.when(F.col("side") == side, F.col("paths")))

    return marks.agg(
        F.max("files").alias("files"),
        F.date_format(F.max("latest"), "yyyy-MM-dd HH:mm:ss").alias("latest"),
        (of("a") != of("b")).cast("int").alias("move_detected"),
        (of("a") == of("c")).cast("int").alias("stable"),
    )
