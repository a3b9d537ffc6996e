"""Dialect A lines of calls with hooks before and after them, batches of one to four calls, answers that are late or missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.fixture_a import stamp
from workload.tables import spread, stored, table

STEP = 100

# DuckDB twin: one row per call ``b``, and per hook ``h``
CALLS_SQL = """
WITH turns AS (SELECT conv_id, turn, length(text) AS n, 'h' || conv_id AS session_id FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, 'call-' || conv_id || '-' || turn || '-' || j AS call_id, turn * 100 + j AS call_unit, CASE WHEN j % 2 = 0 THEN 'Bash' ELSE 'WebFetch' END AS tool_name,
    CASE WHEN (conv_id + turn + j) % 5 <> 0 THEN turn * 100 + 40 + j END AS result_unit, 1 + (conv_id + turn) % 4 AS width
  FROM (SELECT *, unnest(range(1 + (conv_id + turn) % 4)) AS j FROM turns)),
h AS (
  SELECT b.*, 'pre' AS phase, i + 1 AS nth, turn * 100 + 10 + j * 4 + i AS hook_unit, '🪝 PreToolUse:Check' || i AS label, 'pre ' || i AS body
    FROM b, (VALUES (0), (1)) v(i) WHERE i < (conv_id + j) % 3
  UNION ALL SELECT b.*, 'post', i + 1, turn * 100 + 60 + j * 4 + i, CASE WHEN i % 2 = 0 THEN '🪝 PostToolUse:Note' || i ELSE '🪝 PostToolUseFailure:Note' || i || ' (error)' END, 'post ' || i
    FROM b, (VALUES (0), (1), (2)) v(i) WHERE i < (turn + j) % 4)
"""


@stored
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turn, j, i = (F.col(c) for c in ("conv_id", "turn", "j", "i"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    obj = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    at = stamp(conv, turn)
    n = F.length("text")
    call = text("call-", conv, "-", turn, "-", j)
    name = F.when(j % 2 == 0, "Bash").otherwise("WebFetch")
    use = obj(type=F.lit("tool_use"), id=call, name=name, input=obj(command=text("run ", j)))
    said = F.to_json(obj(type=F.lit("assistant"), timestamp=at, message=obj(role=F.lit("assistant"), id=text("m-", conv, "-", turn), stop_reason=F.lit("tool_use"), content=F.array(use))))
    facts = F.when(j % 2 == 1, F.to_json(obj(code=F.lit(200), codeText=F.lit("OK"), bytes=n, durationMs=n * 3 + j, url=F.lit("https://x.example"), result=F.lit("page"))))
    facts = F.coalesce(facts, F.to_json(obj(stdout=F.lit("done"), stderr=F.lit(""), interrupted=F.lit(False))))
    answer = F.to_json(obj(type=F.lit("tool_result"), tool_use_id=call, content=F.lit("done")))
    result = text('{"type":"user","timestamp":"', at, '","message":{"role":"user","content":[', answer, ']},"toolUseResult":', facts, "}")

    def hook(event, hook_name, body, kind="hook_success"):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.to_json(obj(type=F.lit("attachment"), timestamp=at, attachment=obj(type=kind, hookEvent=event, hookName=hook_name, toolUseID=call, stdout=body)))

    event = F.when(i % 2 == 0, "PostToolUse").otherwise("PostToolUseFailure")
    failed = F.when(i % 2 == 0, "hook_success").otherwise("hook_non_blocking_error")
    pre = hook(F.lit("PreToolUse"), text("PreToolUse:Check", i), text("pre ", i))
    again = hook(F.lit("PreToolUse"), F.lit("PreToolUse:Check0"), F.lit("said twice"))
    post = hook(event, text(event, ":Note", i), text("post ", i), failed)
    cases = [
        (F.lit(0) + j, i == 0, said),
        (10 + j * 4 + i, i < (conv + j) % 3, pre),
        (F.lit(13) + j * 4, (i == 0) & ((conv + j) % 3 > 0), again),
        (F.lit(40) + j, (i == 0) & ((conv + turn + j) % 5 != 0), result),
        (60 + j * 4 + i, i < (turn + j) % 4, post),
    ]
    entries = F.array(*[F.struct((turn * STEP + k).alias("off"), F.when(cond, line).alias("line")) for k, cond, line in cases])
    rows = spread(table(spark, sf_dir, "conversations").where("role = 'assistant'"), "conv_id", "turn")
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), ((conv + turn) % 4).cast("int")))).withColumn("i", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    rows = rows.withColumn("x", F.explode(F.filter(entries, lambda e: e["line"].isNotNull())))
    return rows.select(text("h", conv).alias("session_id"), F.floor(F.col("x.off") / 50).cast("bigint").alias("chunk"), F.col("x.off").cast("bigint").alias("off"), "x.line")
