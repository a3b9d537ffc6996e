"""Transcript export for all sessions at once.

One output row per record and one head row per session. Rows are range-partitioned by (session, unit)
and written in order, so a long session spreads over several part files instead of one giant string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions.text import escape_html
from skeinlog.session import cut_lineage

# fixed value: unit of the head row, before every record
HEAD_UNIT = -1
# headings, labels and classes below are fixed values of the output formats

STYLE = "body{max-width:60em;margin:2em auto;font-family:sans-serif}.msg{margin:1em 0;padding:.6em 1em;border:1px solid #ccc}.role{font-weight:bold}pre{white-space:pre-wrap}"


def title(session_title: Column | str = "agent_title") -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("agent_title", "first_prompt", "project_path", "session_id")])


def markdown_record() -> Column:
    kind, text = F.col("record_type"), F.col("content")
    named = F.coalesce(F.col("tool_name"), F.lit("")) != ""
    return (
        F.when(kind == "user", F.concat(F.lit("## 🧑 User\n\n"), text, F.lit("\n")))
        .when(
            (kind == "assistant") & named,
            F.concat(F.lit("### 🔧 "), "tool_name", F.lit("\n\n```json\n"), F.coalesce("tool_input", F.lit("{}")), F.lit("\n```\n")),
        )
        .when(kind == "assistant", F.when(text != "", F.concat(F.lit("## 🤖 Assistant\n\n"), text, F.lit("\n"))))
        .when(kind == "thinking", F.concat(F.lit("> 💭 "), F.replace(text, F.lit("\n"), F.lit("\n> ")), F.lit("\n")))
        .when(kind == "tool_result", F.concat(F.lit("```\n"), text, F.lit("\n```\n")))
        .when(text != "", F.concat(F.lit("_"), kind, F.lit("_: "), text, F.lit("\n")))
    )


def html_record() -> Column:
    kind, text = F.col("record_type"), escape_html(F.col("content"))
    named = F.coalesce(F.col("tool_name"), F.lit("")) != ""
    stamp = F.when(F.col("ts").isNotNull(), F.concat(F.lit('<div class="ts">'), escape_html(F.col("ts")), F.lit("</div>"))).otherwise("")

    def card(style: str, role: Column, body: Column, with_time: bool = False) -> Column:
        return F.concat(
            F.lit(f'<div class="msg {style}"><div class="role">'), role, F.lit("</div>"), stamp if with_time else F.lit(""), F.lit("<pre>"), body, F.lit("</pre></div>")
        )

    return (
        F.when(kind == "user", card("user", F.lit("🧑 User"), text, True))
        .when(
            (kind == "assistant") & named,
            card("tool", F.concat(F.lit("🔧 "), escape_html(F.col("tool_name"))), escape_html(F.coalesce("tool_input", F.lit("{}")))),
        )
        .when(kind == "assistant", card("assistant", F.lit("🤖 Assistant"), text, True))
        .when(kind == "thinking", card("think", F.lit("💭 Thinking"), text))
        .when(kind == "tool_result", card("result", F.lit("↳ Result"), text))
        .when(text != "", card("other", escape_html(kind), text))
    )


def json_record() -> Column:
    return F.to_json(
        F.struct(
            "record_type", F.col("content").alias("content_preview"), F.col("ts").alias("timestamp"), "tool_name",
            F.try_parse_json("tool_input").alias("tool_input"),
        ),
        {"ignoreNullFields": "false"},
    )


def markdown_head(source_label: str) -> Column:
    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {label}: "), value))

    return F.concat(
        F.lit("# "),
        title(),
        F.lit("\n\n"),
        F.concat_ws(
            "\n",
            F.lit(f"- Source: {source_label}"),
            F.concat(F.lit("- Project: "), F.coalesce("project_path", F.lit(""))),
            line("Agent title", F.col("agent_title")),
            line("Created", F.col("created_at")),
            line("Updated", F.col("updated_at")),
        ),
        F.lit("\n"),
    )


def html_head(source_label: str) -> Column:
    when = F.when(F.col("updated_at").isNotNull(), F.concat(F.lit(" · Updated "), "updated_at")).otherwise("")
    return F.concat(
        F.lit("<h1>"), escape_html(title()), F.lit(f'</h1><div class="meta">{source_label} · '),
        escape_html(F.coalesce("project_path", F.lit(""))), escape_html(when), F.lit("</div>"),
    )


def json_head() -> Column:
    return F.to_json(
        F.struct("session_id", "project_path", "agent_title", "created_at", "updated_at", "first_prompt"), {"ignoreNullFields": "false"}
    )


def export_rows(sessions: DataFrame, records: DataFrame, fmt: str, source_label: str) -> DataFrame:
    """(session_id, unit, seq, text) of the chosen format: md, html or json."""
    head = {"md": markdown_head(source_label), "html": html_head(source_label), "json": json_head()}[fmt]
    row = {"md": markdown_record(), "html": html_record(), "json": json_record()}[fmt]
    heads = sessions.select("session_id", F.lit(HEAD_UNIT).cast("bigint").alias("unit"), F.lit(0).alias("seq"), head.alias("text"))
    rows = records.select("session_id", F.col("unit").cast("bigint").alias("unit"), F.col("seq").cast("int").alias("seq"), row.alias("text"))
    return heads.unionByName(rows.where("text is not null"))


def document_rows(sessions: DataFrame, records: DataFrame, fmt: str, source_label: str) -> DataFrame:
    """Rows (session_id, unit, seq, text) that are a whole document per session when their texts are put one below the other.

    HTML gets its opening and closing, JSON becomes one object with the array ``records``. Only which record comes first is learned per session.
    """
    rows = export_rows(sessions, records, fmt, source_label)
    if fmt == "md":
        return rows
    order = F.struct("unit", "seq")
    end = sessions.select("session_id", F.lit(2**62).alias("unit"), F.lit(0).alias("seq"), F.lit("</body></html>" if fmt == "html" else "]}").alias("text"))
    is_head = F.col("unit") == HEAD_UNIT
    if fmt == "html":
        names = sessions.select("session_id", F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escape_html(title()), F.lit(f"</title><style>{STYLE}</style></head><body>\n")).alias("opening"))
        opened = rows.where(is_head).join(names, "session_id").select("session_id", "unit", "seq", F.concat("opening", "text").alias("text"))
        return opened.unionByName(rows.where(~is_head)).unionByName(end)
    # the head object stays open for the records
    head = rows.where(is_head).withColumn("text", F.concat(F.expr("left(text, length(text) - 1)"), F.lit(',"records":[')))
    body = rows.where(~is_head)
    firsts = body.groupBy("session_id").agg(F.min(order).alias("first"))
    body = body.join(firsts, "session_id").select("session_id", "unit", "seq", F.when(order == F.col("first"), F.col("text")).otherwise(F.concat(F.lit(","), "text")).alias("text"))
    return head.unionByName(body).unionByName(end)


def write_documents(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Plain text, a folder per session; its part files, in the order of their names, are the document.

    Ranges of (session, unit) go to one task each, so a long session is several parts and no task holds it whole.
    """
    order = ["session_id", "unit", "seq"]
    rows = cut_lineage(rows.select(*order, "text"), "export-rows")
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("session_id", "text").write.partitionBy("session_id").text(path)


def write_export(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted text files; within and across part files the order is (session, unit, seq).

    The rows are written once before they are ranged, because finding the range bounds samples its input.
    """
    order = ["session_id", "unit", "seq"]
    rows = cut_lineage(rows, "export-rows")
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select(F.to_json(F.struct("session_id", "unit", "text")).alias("value")).write.text(path)
