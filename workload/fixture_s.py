"""Session rows built by Spark from ``events``: one per user and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.tables import table

SESSIONS_SQL = """
s AS (
  SELECT CASE user_id % 4 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'opencode' ELSE 'pi' END AS source,
    's' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS session_id, 'slug-p' || (user_id % 17) AS project,
    CASE WHEN user_id % 17 = 16 THEN '' ELSE '/work/p' || (user_id % 17) END AS project_path,
    CASE WHEN user_id % 10 = 9 THEN 'snap-' || (user_id % 3) END AS archive_name,
    CASE user_id % 7 WHEN 0 THEN 'claude-opus-4-6' WHEN 1 THEN 'anthropic/claude-sonnet-4-6' WHEN 2 THEN 'gpt-5.4-mini'
      WHEN 3 THEN 'openai/gpt-5.5' WHEN 4 THEN 'gemini-3' WHEN 5 THEN 'mystery-model' END AS model,
    max(user_id) AS user_id, min(ts) AS created_at, max(ts) AS modified, count(*) AS events,
    sum(CASE WHEN event_type = 'view' THEN c ELSE 0 END)::BIGINT AS input_tokens, sum(CASE WHEN event_type = 'click' THEN c ELSE 0 END)::BIGINT AS output_tokens,
    sum(CASE WHEN event_type NOT IN ('view', 'click') THEN c ELSE 0 END)::BIGINT AS cache_tokens, sum(c)::BIGINT AS total_tokens
  FROM (SELECT *, CAST(ROUND(value * 100) AS BIGINT) AS c FROM events) GROUP BY ALL)
"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank project paths, archived rows, missing and unpriced models occur on purpose."""
    user, kind = F.col("user_id"), F.col("event_type")
    c = F.round(F.col("value") * 100).cast("bigint")
    day = F.date_format("ts", "yyyy-MM-dd")
    model = F.get(
        F.array(*[F.lit(m) for m in ("claude-opus-4-6", "anthropic/claude-sonnet-4-6", "gpt-5.4-mini", "openai/gpt-5.5", "gemini-3", "mystery-model")]),
        (user % 7).cast("int"),
    )
    sums = {
        "input_tokens": F.when(kind == "view", c).otherwise(0),
        "output_tokens": F.when(kind == "click", c).otherwise(0),
        "cache_tokens": F.when(~kind.isin("view", "click"), c).otherwise(0),
        "total_tokens": c,
    }
    rows = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("modified"), F.count("*").alias("events"),
        *[F.sum(v).cast("bigint").alias(n) for n, v in sums.items()],
    )
    slug = F.concat(F.lit("p"), (user % 17).cast("string"))
    second = F.when(user % 5 == 0, F.lit(" GPT-5.4-MINI ")).otherwise(F.lit("extra-model"))

    def context(name):
        return F.struct(F.lit(None).cast("string").alias("provider"), name.alias("model"), F.lit(None).cast("string").alias("thinking_level"))

    return rows.select(
        F.get(F.array(F.lit("claude"), F.lit("codex"), F.lit("opencode"), F.lit("pi")), (user % 4).cast("int")).alias("source"),
        F.concat(F.lit("s"), user.cast("string"), F.lit("-"), "day").alias("session_id"),
        F.concat(F.lit("slug-"), slug).alias("project"),
        F.when(user % 17 == 16, "").otherwise(F.concat(F.lit("/work/"), slug)).alias("project_path"),
        F.when(user % 10 == 9, F.concat(F.lit("snap-"), (user % 3).cast("string"))).alias("archive_name"),
        F.filter(F.array(context(model), F.when(user % 3 == 0, context(second))), lambda x: x.isNotNull()).alias("model_contexts"),
        F.when(user % 6 != 0, F.concat(F.lit("Prompt of "), user.cast("string"))).alias("first_prompt"),
        F.when(user % 8 == 0, F.concat(F.lit("Title "), user.cast("string"))).alias("agent_title"),
        "user_id",
        "created_at",
        "modified",
        "events",
        *sums,
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    tags = F.array(F.lit(" fast "), F.lit("fast"), F.lit("  "), F.concat(F.lit("t"), (user % 3).cast("string")))
    rows = sessions(spark, sf_dir).where(user % 5 == 0)
    return rows.select(
        F.concat_ws("::", "source", "session_id").alias("key"),
        (user % 2 == 0).alias("favorite"),
        (user % 3 == 0).alias("pinned"),
        F.when(user % 10 == 0, tags).otherwise(F.expr("cast(array() as array<string>)")).alias("tags"),
        F.when(user % 15 == 5, "note").otherwise("").alias("note"),
    )
