"""Usage, dashboard, cost, price and annotation reports over session rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlog.functions import pricing as PF
from skeinlog.functions import text as X
from skeinlog.plans import annotations as N
from skeinlog.plans import dashboard, pricing, scope, usage
from workload import fixture_s
from workload.registry import Area

area = Area()
BASE = "WITH " + fixture_s.SESSIONS_SQL
SUMS = """count(*) AS sessions, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(cache_tokens)::BIGINT AS cache_tokens, sum(total_tokens)::BIGINT AS total_tokens"""
CUR = "FROM s WHERE archive_name IS NULL"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def _s(spark, sf_dir):
    return fixture_s.sessions(spark, sf_dir)


def _text(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


@area.query("usage_totals", BASE + f"SELECT {SUMS} {CUR}")
def usage_totals(spark, sf_dir):
    return usage.totals(_s(spark, sf_dir))


@area.query("usage_by_source_report", BASE + f"SELECT source AS key, {SUMS} {CUR} GROUP BY 1")
def usage_by_source_report(spark, sf_dir):
    return usage.by_source(_s(spark, sf_dir))


FIRST_MODEL = "coalesce(model, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 5 = 0 THEN ' GPT-5.4-MINI ' ELSE 'extra-model' END END, 'unknown')"


@area.query("usage_by_model", BASE + f"SELECT {FIRST_MODEL} AS key, {SUMS} {CUR} GROUP BY 1")
def usage_by_model(spark, sf_dir):
    return usage.by_model(_s(spark, sf_dir))


@area.query(
    "usage_by_project",
    BASE + f"SELECT project_path AS key, {SUMS} {CUR} GROUP BY 1 ORDER BY total_tokens DESC, sessions DESC, key",
)
def usage_by_project(spark, sf_dir):
    return usage.by_project(_s(spark, sf_dir))


@area.query("usage_by_day", BASE + f"SELECT strftime(modified, '%Y-%m-%d') AS key, {SUMS} {CUR} GROUP BY 1")
def usage_by_day(spark, sf_dir):
    return usage.by_day(_s(spark, sf_dir))


@area.query(
    "usage_summary",
    BASE
    + " UNION ALL ".join(
        f"SELECT '{name}' AS report, {key} AS key, {SUMS} {CUR} {'GROUP BY ' + key if name != 'total' else ''}"
        for name, key in [
            ("total", "''"), ("source", "source"), ("model", FIRST_MODEL), ("project", "project_path"), ("day", "strftime(modified, '%Y-%m-%d')"),
        ]
    ),
)
def usage_summary(spark, sf_dir):
    return usage.summary(_s(spark, sf_dir))


MODELS = f""", m AS (
  SELECT trim(model) AS model {CUR} AND model IS NOT NULL
  UNION SELECT CASE WHEN user_id % 5 = 0 THEN 'GPT-5.4-MINI' ELSE 'extra-model' END {CUR} AND user_id % 3 = 0),
d AS (SELECT min(model) AS model FROM m GROUP BY lower(model))
"""


@area.query("discovered_models", BASE + MODELS + "SELECT model FROM d")
def discovered_models(spark, sf_dir):
    return usage.discovered_models(_s(spark, sf_dir))


@area.query(
    "usage_formatted",
    BASE
    + f"""SELECT source, CASE WHEN t >= 1000000000 THEN printf('%.2fB', t / 1e9) WHEN t >= 1000000 THEN printf('%.2fM', t / 1e6)
      WHEN t >= 1000 THEN printf('%.1fK', t / 1e3) ELSE t::VARCHAR END AS tokens,
    CASE WHEN t >= 1073741824 THEN printf('%.1f GB', t / 1073741824.0) WHEN t >= 1048576 THEN printf('%.1f MB', t / 1048576.0)
      WHEN t >= 1024 THEN printf('%.1f KB', t / 1024.0) ELSE t || ' B' END AS bytes
    FROM (SELECT source, sum(total_tokens)::BIGINT AS t {CUR} GROUP BY 1)""",
)
def usage_formatted(spark, sf_dir):
    rows = usage.by_source(_s(spark, sf_dir))
    t = F.col("total_tokens")
    return rows.select(F.col("key").alias("source"), X.human_tokens(t).alias("tokens"), X.human_bytes(t).alias("bytes"))


@area.query(
    "dashboard_recent",
    BASE + f"SELECT source, session_id, strftime(modified, {STAMP}) AS modified {CUR} ORDER BY s.modified DESC, source, session_id LIMIT 10",
)
def dashboard_recent(spark, sf_dir):
    return dashboard.recent(_s(spark, sf_dir), 10).select("source", "session_id", _text("modified"))


@area.query(
    "dashboard_sources",
    BASE + f"SELECT source, count(*) AS sessions, strftime(max(modified), {STAMP}) AS last_active {CUR} GROUP BY 1",
)
def dashboard_sources(spark, sf_dir):
    return dashboard.by_source(_s(spark, sf_dir)).select("source", "sessions", _text("last_active"))


@area.query(
    "source_health",
    BASE
    + f""", k(source, display_name) AS (VALUES ('claude', 'Claude Code'), ('codex', 'Codex'), ('opencode', 'OpenCode'), ('pi', 'PiAgent'), ('none', 'No sessions')),
    t AS (SELECT source, count(*) AS n, strftime(max(modified), {STAMP}) AS last_active {CUR} GROUP BY 1)
    SELECT k.source, k.display_name, coalesce(n, 0) AS sessions, last_active FROM k LEFT JOIN t USING (source)""",
)
def source_health(spark, sf_dir):
    known = scope.sources(spark, [("none", "No sessions", False)])
    return dashboard.source_health(known, _s(spark, sf_dir)).select("source", "display_name", "sessions", _text("last_active"))


@area.query(
    "dashboard_projects",
    BASE
    + f"""SELECT CASE WHEN project_path = '' THEN project ELSE project_path END AS path, count(*) AS sessions, strftime(max(modified), {STAMP}) AS last_active
    {CUR} GROUP BY 1 ORDER BY sessions DESC, max(modified) DESC, path LIMIT 8""",
)
def dashboard_projects(spark, sf_dir):
    return dashboard.top_projects(_s(spark, sf_dir), 8).select("path", "sessions", _text("last_active"))


@area.query(
    "dashboard_activity",
    BASE
    + f""", days AS (SELECT unnest(generate_series(DATE '2024-01-17', DATE '2024-02-15', INTERVAL 1 DAY))::DATE AS d),
    n AS (SELECT modified::DATE AS d, count(*) AS c {CUR} GROUP BY 1)
    SELECT strftime(days.d, '%Y-%m-%d') AS day, coalesce(c, 0) AS sessions FROM days LEFT JOIN n USING (d)""",
)
def dashboard_activity(spark, sf_dir):
    return dashboard.activity(_s(spark, sf_dir), F.lit("2024-02-15").cast("date"))


@area.query(
    "browse_sessions",
    BASE
    + """SELECT source, session_id, CASE WHEN user_id % 6 <> 0 THEN 'Prompt of ' || user_id ELSE project_path END AS snippet
    FROM s WHERE archive_name IS NOT NULL ORDER BY modified DESC, source, session_id""",
)
def browse_sessions(spark, sf_dir):
    return dashboard.browse(_s(spark, sf_dir), "archived").select("source", "session_id", "snippet")


@area.query(
    "sessions_in_scope",
    BASE + """SELECT source, session_id, coalesce(archive_name, '') AS archive FROM s WHERE source = 'codex' AND (project = 'slug-p5' OR project_path = 'slug-p5')""",
)
def sessions_in_scope(spark, sf_dir):
    rows = scope.in_scope(_s(spark, sf_dir), "all", "codex", "slug-p5")
    return rows.select("source", "session_id", F.coalesce("archive_name", F.lit("")).alias("archive"))


@area.query("searchable_sources", BASE + f"SELECT source, count(*) AS sessions {CUR} AND source <> 'pi' GROUP BY 1")
def searchable_sources(spark, sf_dir):
    declared = scope.sources(spark).withColumn("sessions_search", F.col("source") != "pi")
    return scope.searchable(scope.in_scope(_s(spark, sf_dir)), declared).groupBy("source").agg(F.count("*").alias("sessions"))


@area.query(
    "session_titles",
    BASE
    + f"""SELECT source, CASE WHEN user_id % 8 = 0 THEN 'titled' WHEN user_id % 6 <> 0 THEN 'prompted' ELSE 'untitled' END AS shown, count(*) AS sessions {CUR} GROUP BY 1, 2""",
)
def session_titles(spark, sf_dir):
    title = X.display_title(F.col("agent_title"), F.col("first_prompt"))
    shown = F.when(title.startswith("Title"), "titled").when(title.startswith("Prompt"), "prompted").otherwise("untitled")
    return scope.in_scope(_s(spark, sf_dir)).groupBy("source", shown.alias("shown")).agg(F.count("*").alias("sessions"))


PRICES = (
    ", price(pos, match, pin, pout) AS (VALUES "
    + ", ".join(f"({i}, '{m}', {a}::DOUBLE, {b}::DOUBLE)" for i, (m, a, b) in enumerate(PF.DEFAULT_PRICES))
    + f""")
, u AS (SELECT {FIRST_MODEL} AS model, {SUMS} {CUR} GROUP BY 1)
, pm AS (SELECT u.model, match, pin, pout, row_number() OVER (PARTITION BY u.model ORDER BY length(match) DESC, pos) AS rn FROM u JOIN price
   ON starts_with(regexp_replace(replace(lower(trim(u.model)), '.', '-'), '^.*/', ''), replace(match, '.', '-'))
   OR starts_with(replace(lower(trim(u.model)), '.', '-'), replace(match, '.', '-')))
, c AS (SELECT u.*, pm.match AS matched, input_tokens / 1e6 * pin + cache_tokens / 1e6 * pin * 0.1 + output_tokens / 1e6 * pout AS cost
   FROM u LEFT JOIN pm ON pm.model = u.model AND rn = 1)
"""
)


@area.query(
    "cost_by_model", BASE + PRICES + "SELECT model, matched, total_tokens, round(cost, 4) AS cost FROM c"
)
def cost_by_model(spark, sf_dir):
    rows = pricing.cost_by_model(_s(spark, sf_dir), pricing.price_table(spark))
    return rows.select("model", "matched", "total_tokens", F.round("cost", 4).alias("cost"))


@area.query(
    "cost_total",
    BASE + PRICES + "SELECT round(coalesce(sum(cost), 0), 4) AS cost, coalesce(bool_or(cost IS NULL AND total_tokens > 0), false)::INT AS has_unknown FROM c",
)
def cost_total(spark, sf_dir):
    rows = pricing.cost_total(_s(spark, sf_dir), pricing.price_table(spark))
    return rows.select(F.round("cost", 4).alias("cost"), F.col("has_unknown").cast("int").alias("has_unknown"))


@area.query(
    "cost_labels",
    BASE + PRICES + "SELECT model, CASE WHEN cost >= 100 THEN printf('$%.0f', cost) WHEN cost >= 1 THEN printf('$%.2f', cost) ELSE printf('$%.3f', cost) END AS label FROM c WHERE cost IS NOT NULL",
)
def cost_labels(spark, sf_dir):
    rows = pricing.cost_by_model(_s(spark, sf_dir), pricing.price_table(spark)).where("cost is not null")
    return rows.select("model", X.human_usd(F.col("cost")).alias("label"))


def _catalog(spark, sf_dir):
    """Catalog entries derived from the models in use: plain, alias and variant ids."""
    models = usage.discovered_models(_s(spark, sf_dir))
    per_token = F.format_string("%.9f", F.length("model") / F.lit(1e6))
    base = models.select("model", per_token.alias("prompt"))
    plain = base.where("model <> 'mystery-model'").select(
        F.lit(2).alias("pos"), F.concat(F.lit("vendor/"), "model").alias("id"), F.lit(None).cast("string").alias("canonical_slug"), "prompt", F.lit("0.000002").alias("completion")
    )
    alias = base.select(F.lit(1).alias("pos"), F.concat(F.lit("~vendor/"), "model").alias("id"), F.lit(None).cast("string").alias("canonical_slug"), F.lit("9").alias("prompt"), F.lit("-1").alias("completion"))
    variant = base.select(F.lit(0).alias("pos"), F.concat("model", F.lit(":batch")).alias("id"), F.lit(None).cast("string").alias("canonical_slug"), F.lit("7").alias("prompt"), F.lit("7").alias("completion"))
    return plain.unionByName(alias).unionByName(variant)


@area.query(
    "price_refresh_report",
    BASE
    + MODELS
    + """SELECT model, CASE WHEN model = 'mystery-model' THEN 9e6 ELSE round(printf('%.9f', length(model) / 1e6)::DOUBLE * 1000000, 3) END AS input,
      CASE WHEN model <> 'mystery-model' THEN round('0.000002'::DOUBLE * 1000000, 3) END AS output,
      CASE WHEN model = 'mystery-model' THEN '~vendor/' ELSE 'vendor/' END || model AS matched_model FROM d""",
)
def price_refresh_report(spark, sf_dir):
    rows = pricing.refresh_report(usage.discovered_models(_s(spark, sf_dir)), _catalog(spark, sf_dir))
    return rows.select("model", F.round("input", 3).alias("input"), F.round("output", 3).alias("output"), "matched_model")


@area.query(
    "price_fallback_report",
    BASE
    + MODELS
    + ", f(matched_model, input, output) AS (VALUES "
    + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in PF.FALLBACK_PRICES)
    + """), k AS (SELECT model, replace(regexp_replace(lower(model), '^.*/', ''), '.', '-') AS n FROM d)
    SELECT model, input, output, matched_model FROM k LEFT JOIN f ON f.matched_model = k.n
    UNION ALL SELECT matched_model, input, output, matched_model FROM f WHERE matched_model NOT IN (SELECT n FROM k)""",
)
def price_fallback_report(spark, sf_dir):
    return pricing.fallback_report(usage.discovered_models(_s(spark, sf_dir)))


@area.query(
    "normalized_model_ids",
    BASE + MODELS + "SELECT model, replace(regexp_replace(lower(model), '^.*/', ''), '.', '-') AS normalized FROM d",
)
def normalized_model_ids(spark, sf_dir):
    models = usage.discovered_models(_s(spark, sf_dir))
    tagged = models.select("model", F.concat(F.lit(" ~"), "model", F.lit(":batch")).alias("written"))
    return tagged.select("model", PF.normalized_id(F.col("written")).alias("normalized"))


NOTES = """, n AS (
  SELECT source || '::' || session_id AS key, user_id % 2 = 0 AS favorite, user_id % 3 = 0 AS pinned,
    CASE WHEN user_id % 10 = 0 THEN ['fast', 't' || (user_id % 3)] ELSE [] END AS tags, CASE WHEN user_id % 15 = 5 THEN 'note' ELSE '' END AS note
  FROM s WHERE user_id % 5 = 0),
kept AS (SELECT * FROM n WHERE favorite OR pinned OR len(tags) > 0 OR note <> '')
"""


def _notes(spark, sf_dir):
    rows = fixture_s.annotations(spark, sf_dir)
    return N.upsert(rows.where("false"), rows)


@area.query(
    "annotation_upsert",
    BASE + NOTES + "SELECT key, favorite::INT AS favorite, pinned::INT AS pinned, array_to_string(tags, '|') AS tags, note FROM kept WHERE NOT ends_with(key, '7')"
    " UNION ALL SELECT key, 0, 0, 'done', '' FROM n WHERE ends_with(key, '7')",
)
def annotation_upsert(spark, sf_dir):
    """A second round of updates replaces every key that ends in 7, including keys that had been dropped."""
    rows = fixture_s.annotations(spark, sf_dir)
    updates = rows.where(F.col("key").endswith("7")).select(
        "key", F.lit(False).alias("favorite"), F.lit(False).alias("pinned"), F.array(F.lit(" done "), F.lit("done")).alias("tags"), F.lit("").alias("note")
    )
    merged = N.upsert(_notes(spark, sf_dir), updates)
    return merged.select(
        "key", F.col("favorite").cast("int").alias("favorite"), F.col("pinned").cast("int").alias("pinned"), F.array_join("tags", "|").alias("tags"), "note"
    )


@area.query(
    "annotated_sessions",
    BASE + NOTES + """SELECT source, session_id, coalesce(pinned, false)::INT AS pinned, array_to_string(coalesce(tags, []), '|') AS tags
    FROM s LEFT JOIN kept ON key = source || '::' || session_id WHERE archive_name IS NULL AND coalesce(favorite, false) AND list_contains(tags, 'fast')""",
)
def annotated_sessions(spark, sf_dir):
    rows = N.annotated(scope.in_scope(_s(spark, sf_dir)), _notes(spark, sf_dir))
    return N.marked(rows, favorites_only=True, tag="fast").select(
        "source", "session_id", F.col("pinned").cast("int").alias("pinned"), F.array_join("tags", "|").alias("tags")
    )


@area.query("tag_counts", BASE + NOTES + "SELECT tag, count(*) AS sessions FROM (SELECT unnest(tags) AS tag FROM kept) GROUP BY 1")
def tag_counts(spark, sf_dir):
    return N.all_tags(_notes(spark, sf_dir))
