"""Tool configuration files flattened to servers and hooks. Secret values are never projected, only key names.

Every reader takes ``files(path, scope, content)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import configs as C
from skeinlog.functions import strings
from skeinlog.functions import variants as V
from skeinlog.sources.files import read_whole

SERVER_COLUMNS = ["path", "scope", "name", "transport", "command", "args", "env_keys", "enabled"]
HOOK_COLUMNS = ["path", "scope", "event", "matcher", "commands"]
_NO_STRINGS = "cast(array() as array<string>)"
MAP = "map<string,variant>"


def _strings(v: Column, path: str) -> Column:
    items = F.transform(V.array(v, path), lambda i: V.text(i, "$"))
    return F.coalesce(F.filter(items, lambda i: i.isNotNull()), F.expr(_NO_STRINGS))


def _keys(v: Column, path: str) -> Column:
    return F.coalesce(F.map_keys(F.try_variant_get(v, path, MAP)), F.expr(_NO_STRINGS))


def _enabled(v: Column) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(V.sub(v, "$.enabled")) == "BOOLEAN", V.get(v, "$.enabled", "boolean")), F.lit(True))


def read_configs(spark: SparkSession, root: str, scope: str = "global") -> DataFrame:
    """``files`` of every JSON, JSONC and TOML config below a root."""
    return read_whole(spark, root).where(F.col("path").rlike(r"\.(json|jsonc|toml)$")).select("path", F.lit(scope).alias("scope"), "content")


def servers(files: DataFrame) -> DataFrame:
    """Servers of configs of any format, each read by its file name."""
    of = lambda ending: files.where(F.col("path").endswith(ending))
    parts = [json_servers(of(".json")), jsonc_servers(of(".jsonc")), toml_servers(of(".toml"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def json_servers(files: DataFrame) -> DataFrame:
    """Servers of a JSON config: global ones, and those of each project in it."""
    v = F.col("v")
    docs = files.select("path", "scope", V.parse("content").alias("v")).where("v is not null")
    top = docs.select("path", "scope", F.explode(F.try_variant_get(v, "$.mcpServers", MAP)).alias("name", "c"))
    projects = docs.select("path", F.explode(F.try_variant_get(v, "$.projects", MAP)).alias("scope", "p"))
    nested = projects.select("path", "scope", F.explode(F.try_variant_get("p", "$.mcpServers", MAP)).alias("name", "c"))
    c = F.col("c")
    command, url = V.text(c, "$.command"), V.text(c, "$.url")
    guessed = F.when(url.isNotNull(), "http").when(command.isNotNull(), "stdio").otherwise("unknown")
    return top.unionByName(nested).select(
        "path",
        "scope",
        "name",
        F.coalesce(V.text(c, "$.type"), guessed).alias("transport"),
        F.coalesce(command, url, F.lit("")).alias("command"),
        _strings(c, "$.args").alias("args"),
        _keys(c, "$.env").alias("env_keys"),
        _enabled(c).alias("enabled"),
    )


def json_hooks(files: DataFrame) -> DataFrame:
    docs = files.select("path", "scope", V.parse("content").alias("v")).where("v is not null")
    events = docs.select("path", "scope", F.explode(F.try_variant_get("v", "$.hooks", MAP)).alias("event", "groups"))
    groups = events.select("path", "scope", "event", F.explode(V.array(F.col("groups"), "$")).alias("g"))
    commands = F.filter(
        F.transform(V.array(F.col("g"), "$.hooks"), lambda h: V.text(h, "$.command")), lambda c: c.isNotNull()
    )
    return groups.select(
        "path",
        "scope",
        "event",
        F.coalesce(V.text(F.col("g"), "$.matcher"), F.lit("")).alias("matcher"),
        F.coalesce(commands, F.expr(_NO_STRINGS)).alias("commands"),
    )


def jsonc_servers(files: DataFrame) -> DataFrame:
    """Servers of a JSON config with comments: a command list, environment and header names merged."""
    docs = files.select("path", "scope", C.parse_jsonc(F.col("content")).alias("v")).where("v is not null")
    rows = docs.select("path", "scope", F.explode(F.try_variant_get("v", "$.mcp", MAP)).alias("name", "c"))
    c = F.col("c")
    url = F.coalesce(V.text(c, "$.url"), F.lit(""))
    parts = _strings(c, "$.command")
    remote = (F.coalesce(V.text(c, "$.type"), F.lit("")) == "remote") | (url != "")
    keys = F.array_sort(F.array_distinct(F.concat(*[_keys(c, f"$.{f}") for f in ("environment", "env", "headers")])))
    return rows.select(
        "path",
        "scope",
        "name",
        F.when(remote, "http").otherwise("stdio").alias("transport"),
        F.when(url != "", url).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).alias("command"),
        F.slice(parts, 2, 1_000_000).alias("args"),
        keys.alias("env_keys"),
        _enabled(c).alias("enabled"),
    )


def _toml_lines(files: DataFrame) -> DataFrame:
    """Key/value lines with the section they stand in. A file is one row, so it is cut at its section lines where it is read; no line is shuffled."""
    lines = F.transform(F.split("content", r"\r?\n"), lambda raw: strings.trim(C.strip_toml_comment(raw)))
    rows = files.where("content is not null").select("path", "scope", lines.alias("lines"))
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    heads = F.filter(numbers, lambda i: F.get("lines", i).startswith("[") & F.get("lines", i).endswith("]"))
    rows = rows.withColumn("heads", F.concat(F.array(F.lit(-1)), heads))

    def part(head: Column, nth: Column) -> Column:
        end = F.coalesce(F.get("heads", nth + 1), F.size("lines"))
        name = F.when(head >= 0, strings.trim(F.regexp_extract(F.get("lines", head), r"^\[(.*)\]$", 1))).otherwise("")
        return F.struct((head + 1).alias("at"), name.alias("section"), F.slice("lines", head + 2, end - head - 1).alias("body"))

    # the outer forms, because Spark evaluates what the others explode a second time, to skip empty arrays early
    parts = rows.select("path", "scope", F.explode_outer(F.transform("heads", part)).alias("p"))
    scanned = parts.select("path", "scope", F.col("p.at").alias("at"), F.col("p.section").alias("section"), F.posexplode_outer("p.body").alias("nth", "line"))
    pairs = scanned.where(F.col("line").contains("=")).withColumn("line_no", F.col("at") + F.col("nth"))
    return pairs.select(
        "path",
        "scope",
        "line_no",
        "section",
        F.btrim(strings.trim(F.substring_index("line", "=", 1)), F.lit("\"'")).alias("key"),
        strings.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("value"),
    )


def toml_servers(files: DataFrame) -> DataFrame:
    """Servers of ``[mcp_servers.<name>]`` tables; later lines of a key win, env key names keep their order."""
    parts = F.split(F.regexp_extract("section", r"^mcp_servers\.(.*)$", 1), r"\.")
    rows = _toml_lines(files).where(F.col("section").startswith("mcp_servers.")).select(
        "path", "scope", "line_no", "key", "value",
        F.btrim(F.get(parts, F.lit(0)), F.lit("\"'")).alias("name"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("nested"),
    )
    is_env = F.col("nested").isin("env", "http_headers", "headers")

    def last(key: str, value: Column) -> Column:
        return F.max_by(value, F.when(~is_env & (F.col("key") == key), F.col("line_no")))

    switch = F.when(F.col("key") == "enabled", F.col("value") != "false").when(F.col("key") == "disabled", F.col("value") != "true")
    env = (
        rows.where(is_env & (F.col("name") != ""))
        .groupBy("path", "name", "key")
        .agg(F.min("line_no").alias("at"))
        .groupBy("path", "name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda e: e["key"]).alias("env_keys"))
    )
    servers = rows.where("name <> ''").groupBy("path", "scope", "name").agg(
        last("command", C.toml_string(F.col("value"))).alias("command"),
        last("url", C.toml_string(F.col("value"))).alias("url"),
        last("args", C.toml_array(F.col("value"))).alias("args"),
        F.max_by(switch, F.when(~is_env & switch.isNotNull(), F.col("line_no"))).alias("enabled"),
    )
    has_url = F.coalesce(F.col("url"), F.lit("")) != ""
    return servers.join(env, ["path", "name"], "left").select(
        "path",
        "scope",
        "name",
        F.when(has_url, "http").otherwise("stdio").alias("transport"),
        F.when(has_url, F.col("url")).otherwise(F.coalesce("command", F.lit(""))).alias("command"),
        F.coalesce("args", F.expr(_NO_STRINGS)).alias("args"),
        F.coalesce("env_keys", F.expr(_NO_STRINGS)).alias("env_keys"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )


def toml_hooks(files: DataFrame) -> DataFrame:
    rows = _toml_lines(files).where("section = '' and key = 'notify'")
    return rows.select(
        "path", "scope", F.lit("notify").alias("event"), F.lit("").alias("matcher"), C.toml_array(F.col("value")).alias("commands")
    ).where(F.size("commands") > 0)


def host_tagged(servers: DataFrame, tag: str | None) -> DataFrame:
    """Servers of another host carry its tag in their scope."""
    return servers if tag is None else servers.withColumn("scope", F.concat("scope", F.lit(f" · {tag}")))
