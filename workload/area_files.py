"""From files to answers: transcripts, Markdown and tool configs that Spark wrote as files and reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators import timeline as T
from skeinlog.plans import incremental as R
from skeinlog.session import scratch_path
from skeinlog.sources import configs, corpus, export, files
from skeinlog.sources import dialect_a as A
from skeinlog.sources import dialect_b as B
from workload import fixture_a
from workload.area_a import BASE, SESSION_USAGE
from workload.area_text import area as text_area
from workload.registry import Area
from workload.tables import WITHOUT_CHECKSUMS, spread, table

area = Area()
EXPORTS = text_area.oracles


def write_transcripts(lines: DataFrame, root: str) -> None:
    """Every session as a file below ``projects/<slug>/`` or, a part of them, ``archives/<snapshot>/projects/<slug>/``; file names repeat across projects."""
    n = F.regexp_extract("session_id", r"(\d+)$", 1).cast("bigint")
    rows = lines.select((n % 7 == 6).alias("old"), F.concat(F.lit("-w-p"), (n % 5).cast("string")).alias("slug"), F.concat(F.lit("c"), F.floor(n / 5).cast("string"), F.lit(".jsonl")).alias("file"), "off", "line")
    for old, home in ((False, root), (True, f"{root}/archives/snap")):
        one = spread(rows.where("old" if old else "not old"), "slug", "file").sortWithinPartitions("slug", "file", "off")
        one.select("slug", "file", "line").write.options(**WITHOUT_CHECKSUMS).partitionBy("slug", "file").text(f"{home}/projects")


FILE_KEY = "CASE WHEN conv_id % 7 = 6 THEN 'snap/' ELSE '' END || '-w-p' || (conv_id % 5) || ':c' || (conv_id // 5)"


@area.query(
    "files_to_sessions",
    BASE
    + f""", x AS (SELECT *, role = 'assistant' AS used, CASE WHEN role = 'user' AND NOT (noisy AND conv_id % 2 = 0) THEN text END AS prompt FROM b)
    SELECT {FILE_KEY} AS session_id, CASE WHEN conv_id % 7 = 0 THEN 'Title ' || session_id WHEN conv_id % 7 = 3 THEN 'Sum ' || session_id END AS agent_title,
      arg_min(prompt, turn) FILTER (prompt IS NOT NULL) AS first_prompt, arg_max(ts, turn) FILTER (role <> 'system') AS updated_at, {SESSION_USAGE}
    FROM x GROUP BY session_id, conv_id""",
)
def files_to_sessions(spark, sf_dir):
    """Sessions of transcript files: scan with byte offsets, keys from the path, then the dialect."""
    root = scratch_path(spark, "transcripts")
    write_transcripts(fixture_a.lines(spark, sf_dir), root)
    rows = A.sessions(files.session_lines(files.scan_lines(spark, root, "*")))
    return rows.drop("created_at", "project_path")


@area.query(
    "content_manifest_diff",
    BASE
    + f"SELECT {FILE_KEY} AS key, CASE WHEN count(*) FILTER (role = 'user' AND turn = 0 AND conv_id % 4 = 1) > 0 THEN 'changed' ELSE 'unchanged' END AS status FROM b GROUP BY conv_id",
)
def content_manifest_diff(spark, sf_dir):
    """Edits that keep the size of a file are seen by its digest; times are left out, for both trees were just written."""
    lines = fixture_a.lines(spark, sf_dir)
    n = F.regexp_extract("session_id", r"(\d+)$", 1).cast("bigint")
    edited = F.when((n % 4 == 1) & (F.col("off") == 0), F.replace("line", F.lit('"type":"user"'), F.lit('"type":"USER"'))).otherwise(F.col("line"))

    def manifest(rows: DataFrame) -> DataFrame:
        root = scratch_path(spark, "transcripts")
        write_transcripts(rows, root)
        found = files.content_manifest(files.scan_lines(spark, root, "*"))
        keys = files.session_lines(found.select(F.col("key").alias("file_path"), F.lit(0).alias("chunk"), F.lit(0).alias("off"), F.col("version").alias("line")))
        return keys.select(F.col("session_id").alias("key"), F.regexp_replace("line", r":\d+:", ":").alias("version"))

    return R.manifest_diff(manifest(lines), manifest(lines.withColumn("line", edited)), ("key",)).select("key", "status")


def write_whole(rows: DataFrame, root: str) -> None:
    """``rows(home, name, content)`` as one file each."""
    spread(rows, "home", "name").write.partitionBy("home", "name").text(root)


@area.query(
    "memories_from_files",
    """SELECT '-work-p' || s_suppkey AS project, 'm' || s_suppkey || '.md' AS filename, CASE WHEN s_suppkey % 2 = 0 THEN 'Memory ' || s_suppkey END AS name,
    CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS description, 'Nation ' || s_nationkey || chr(10) || s_name AS body FROM supplier""",
)
def memories_from_files(spark, sf_dir):
    """Markdown files with and without front matter, of varying length."""
    k = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"), F.lit("\n"), "s_name")
    headed = F.concat(F.lit("---\nname: Memory "), k, F.lit("\ndescription: '"), F.col("s_name"), F.lit("'\n---\n\n"), body)
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("-work-p"), k).alias("home"), F.concat(F.lit("m"), k, F.lit(".md")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, headed).otherwise(body).alias("content")
    )
    root = scratch_path(spark, "memories")
    spread(rows, "home", "name").withColumn("below", F.lit("memory")).write.partitionBy("home", "below", "name").text(f"{root}/projects")
    found = corpus.memories(corpus.read_markdown(spark, root))
    return found.select("project", "filename", "name", "description", F.regexp_replace("body", r"\n\z", "").alias("body"))


@area.query(
    "tool_servers_from_files",
    """WITH s AS (SELECT *, s_suppkey % 3 AS f, unnest(range(1 + s_suppkey % 4)) AS i FROM supplier)
    SELECT 'u' || s_suppkey || '/' || ['a.json', 'b.jsonc', 'c.toml'][f + 1] AS file, 'srv' || i AS name,
      CASE WHEN (s_suppkey + i) % 2 = 0 THEN 'stdio' ELSE 'http' END AS transport,
      CASE WHEN (s_suppkey + i) % 2 = 0 THEN 'run-' || s_nationkey ELSE 'https://h/' || s_suppkey || '/' || i || '#x' END AS command,
      CASE WHEN (s_suppkey + i) % 2 = 0 THEN '-n|' || i ELSE '' END AS args, CASE WHEN i % 2 = 1 THEN 'KEY' || i ELSE '' END AS env_keys, (i <> 2)::INT AS enabled FROM s""",
)
def tool_servers_from_files(spark, sf_dir):
    """Config files of three formats whose servers differ in number, kind, arguments, secrets and switches from file to file."""
    key, i = F.col("s_suppkey"), F.col("i")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    local = (key + i) % 2 == 0
    name, command, url = text("srv", i), text("run-", F.col("s_nationkey")), text("https://h/", key, "/", i, "#x")
    secret = i % 2 == 1
    off = i == 2
    json_body = F.when(local, text('"command":"', command, '","args":["-n","', i, '"]')).otherwise(text('"url":"', url, '"'))
    as_json = text('"', name, '":{', json_body, F.when(secret, text(',"env":{"KEY', i, '":"s3cret"}')).otherwise(""), F.when(off, ',"enabled":false').otherwise(""), "}")
    jsonc_body = F.when(local, text('"command": ["', command, '", "-n", "', i, '"] /* local */')).otherwise(text('"type": "remote", "url": "', url, '" // remote\n'))
    as_jsonc = text('"', name, '": {', jsonc_body, F.when(secret, text(', "headers": {"KEY', i, '": "s3cret"}')).otherwise(""), F.when(off, ', "enabled": false').otherwise(""), "}")
    toml_body = F.when(local, text('command = "', command, '" # local\nargs = ["-n", "', i, '"]\n')).otherwise(text('url = "', url, '"\n'))
    as_toml = text("[mcp_servers.", name, "]\n", toml_body, F.when(off, "enabled = false\n").otherwise(""), F.when(secret, text("[mcp_servers.", name, ".env]\nKEY", i, ' = "s3cret"\n')).otherwise(""))
    each = table(spark, sf_dir, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), (key % 4).cast("int"))))
    one = F.when(key % 3 == 0, as_json).when(key % 3 == 1, as_jsonc).otherwise(as_toml)
    joined = lambda sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), sep)
    rows = each.withColumn("text", one).groupBy("s_suppkey").agg(joined(",").alias("commas"), joined("").alias("plain"))
    content = F.when(key % 3 == 0, text('{"mcpServers":{', F.col("commas"), "}}")).when(key % 3 == 1, text("{ // servers\n\"mcp\": {", F.col("commas"), "} }")).otherwise(F.col("plain"))
    file = F.get(F.array(F.lit("a.json"), F.lit("b.jsonc"), F.lit("c.toml")), (key % 3).cast("int"))
    root = scratch_path(spark, "configs")
    write_whole(rows.select(text("u", key).alias("home"), file.alias("name"), content.alias("content")), root)
    found = configs.servers(configs.read_configs(spark, root))
    return found.select(
        F.substring_index("path", "/", -2).alias("file"), "name", "transport", "command", F.array_join("args", "|").alias("args"), F.array_join("env_keys", "|").alias("env_keys"),
        F.col("enabled").cast("int").alias("enabled"),
    )


def _documents(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    """(session_id, document) as written to files and read again, parts put together in the order of their names."""
    lines = fixture_a.lines(spark, sf_dir)
    path = scratch_path(spark, "documents")
    # a file per session: many tasks make them, at least so many that long sessions are cut
    tasks = max(7, int(spark.conf.get("spark.sql.shuffle.partitions")))
    export.write_documents(export.document_rows(A.sessions(lines), A.records(lines, "tool"), fmt, "claude"), path, tasks)
    file = F.col("_metadata.file_path")
    parts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
        F.regexp_extract(file, "session_id=([^/]+)/", 1).alias("session_id"), F.struct(F.substring_index(file, "/", -1).alias("name"), F.col("value").alias("text")).alias("part")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "")
    return parts.groupBy("session_id").agg(joined.alias("document"))


@area.query(
    "markdown_documents",
    f"SELECT session_id, md5(string_agg(text, chr(10) ORDER BY unit, seq) || chr(10)) AS digest FROM ({EXPORTS['export_markdown']}) GROUP BY 1",
)
def markdown_documents(spark, sf_dir):
    return _documents(spark, sf_dir, "md").select("session_id", F.md5(F.encode("document", "UTF-8")).alias("digest"))


@area.query(
    "json_documents",
    f"""SELECT session_id, max(agent_title) AS agent_title, count(*) FILTER (unit >= 0) AS records, coalesce(sum(length(content_preview)), 0)::BIGINT AS chars,
    arg_min(record_type, (unit, seq)) FILTER (unit >= 0) AS first_type, arg_max(record_type, (unit, seq)) FILTER (unit >= 0) AS last_type FROM ({EXPORTS['export_json']}) GROUP BY 1""",
)
def json_documents(spark, sf_dir):
    """Every document is one JSON object with its records in order."""
    kind = "struct<agent_title:string,records:array<struct<record_type:string,content_preview:string>>>"
    rows = _documents(spark, sf_dir, "json").select("session_id", F.from_json("document", kind, {"mode": "FAILFAST"}).alias("d"))
    r = F.col("d.records")
    chars = F.aggregate(F.transform(r, lambda x: F.length(x["content_preview"])), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return rows.select(
        "session_id", "d.agent_title", F.size(r).cast("bigint").alias("records"), chars.alias("chars"), F.get(r, F.lit(0))["record_type"].alias("first_type"), F.element_at(r, -1)["record_type"].alias("last_type")
    )


@area.query(
    "html_documents",
    f"""SELECT session_id, 1 AS opened, 1 AS closed, count(*) FILTER (unit >= 0) AS cards FROM ({EXPORTS['export_html']}) GROUP BY 1""",
)
def html_documents(spark, sf_dir):
    doc = F.col("document")
    opened, closed = doc.rlike(r"(?s)\A<!doctype html><html><head>.*</head><body>\n<h1>"), doc.rlike(r"</body></html>\n\z")
    cards = F.regexp_count(doc, F.lit('(?m)^<div class="msg ')).cast("bigint")
    return _documents(spark, sf_dir, "html").select("session_id", opened.cast("int").alias("opened"), closed.cast("int").alias("closed"), cards.alias("cards"))


@area.query(
    "workflow_words_behind_the_short_form",
    """SELECT 'w' || doc_id AS name FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(t)), lambda t: t <> '' AND NOT starts_with(t, '#'))[1] AS l FROM documents)
    WHERE contains(lower(l), 'ation') OR contains('w' || doc_id, 'ation')""",
)
def workflow_words_behind_the_short_form(spark, sf_dir):
    """The filter searches whole descriptions, of which lists show the first 160 characters."""
    path = F.concat(F.lit("/h/plans/w"), F.col("doc_id").cast("string"), F.lit(".md"))
    rows = corpus.workflows(table(spark, sf_dir, "documents").select(path.alias("path"), F.octet_length("text").alias("size_bytes"), F.col("text").alias("content")))
    return corpus.matching_workflows(rows, "plan", "ation").select("name")


@area.query(
    "results_without_terminal_controls",
    """SELECT 'a' || event_id AS session_id, 0 AS unit, 'user' AS record_type, 'quoted ' || chr(27) || '[31m stays' AS content, NULL AS stderr FROM events
    UNION ALL SELECT 'a' || event_id, 1, 'tool_result', 'ok ' || event_id || chr(10) || 'end', CASE WHEN event_id % 2 = 0 THEN 'warn "' || event_id || '"' END FROM events
    UNION ALL SELECT 'b' || event_id, 0, 'tool_result', 'error ' || event_id, NULL FROM events""",
)
def results_without_terminal_controls(spark, sf_dir):
    """Colours, links and carriage returns in results and stderr of two dialects; texts that quote them keep them."""
    e = F.col("event_id").cast("string")
    obj = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    zero = F.lit(0).cast("bigint")
    events = table(spark, sf_dir, "events")
    said = F.to_json(obj(type=F.lit("user"), message=obj(role=F.lit("user"), content=F.lit("quoted \x1b[31m stays"))))
    out = F.concat(F.lit("\x1b[32;1mok\x1b[0m "), e, F.lit("\r\n\x1b]8;;file:///x\x07end\x1b]8;;\x1b\\"))
    err = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('\x1b[33mwarn\x1b[0m "'), e, F.lit('"'))).otherwise("")
    result = F.to_json(obj(type=F.lit("user"), message=obj(role=F.lit("user"), content=F.array(obj(type=F.lit("tool_result"), tool_use_id=F.lit("t"), content=out))), toolUseResult=obj(stdout=out, stderr=err)))
    a = events.select(F.concat(F.lit("a"), e).alias("session_id"), zero.alias("chunk"), F.posexplode(F.array(said, result)).alias("off", "line")).withColumn("off", F.col("off").cast("bigint"))
    answer = F.to_json(obj(type=F.lit("response_item"), payload=obj(type=F.lit("function_call_output"), call_id=F.lit("t"), output=F.concat(F.lit("\u009b31merror\u009b0m "), e))))
    b = events.select(F.concat(F.lit("b"), e).alias("session_id"), zero.alias("chunk"), zero.alias("off"), answer.alias("line"))
    shown = T.without_terminal_formatting(A.records(a).unionByName(B.records(b)))
    return shown.select("session_id", "unit", "record_type", "content", F.get_json_object("result_meta", "$.terminal.stderr").alias("stderr"))
