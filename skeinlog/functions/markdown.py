"""Front matter of Markdown files (flat ``key: value`` fields)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import strings

# opening fence, block, closing fence at the start of a line, rest
FENCED = r"(?s)\A\s*---[\r\n]*+(.*?)\n---(.*)\z"
DESCRIPTION_CHARS = 160
MEMORY_INDEX = "MEMORY.md"


def front_matter(content: Column) -> Column:
    return F.when(content.rlike(FENCED), F.regexp_extract(content, FENCED, 1))


def body(content: Column) -> Column:
    rest = F.regexp_replace(F.regexp_extract(content, FENCED, 2), r"\A[\r\n]+", "")
    return F.when(content.rlike(FENCED), rest).otherwise(content)


def join_front_matter(block: Column, text: Column) -> Column:
    return F.concat(F.lit("---\n"), strings.trim(block), F.lit("\n---\n\n"), text)


def field(block: Column, name: str) -> Column:
    """Value of a top-level field without its quotes; null when missing or blank."""
    raw = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.nullif(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def nested_field(block: Column, parent: str, name: str) -> Column:
    raw = F.regexp_extract(block, rf"(?m)^{parent}:[ \t]*\r?\n(?:[ \t]+.*\r?\n)*?[ \t]+{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.nullif(F.regexp_replace(raw, r"""^(["'])(.*)\1$""", "$2"), F.lit(""))


def memory_type(filename: Column, block: Column) -> Column:
    return F.when(filename == MEMORY_INDEX, "index").otherwise(
        F.coalesce(field(block, "type"), nested_field(block, "metadata", "type"))
    )


def _shorten(text: Column) -> Column:
    return F.when(F.length(text) > DESCRIPTION_CHARS, F.concat(F.left(text, F.lit(DESCRIPTION_CHARS)), F.lit("…"))).otherwise(text)


def workflow_description(content: Column, whole: bool = False) -> Column:
    """The ``description`` field, else the first body line that is neither blank nor a heading; shortened for lists unless ``whole``."""
    lines = F.transform(F.split(body(content), "\n"), strings.trim)
    first = F.get(F.filter(lines, lambda t: (t != "") & ~t.startswith("#")), F.lit(0))
    named = F.regexp_extract(front_matter(content), r"(?m)^[ \t]*description:(.*)$", 1)
    named = strings.trim(F.btrim(strings.trim(named), F.lit("\"'")))
    text = F.coalesce(F.nullif(named, F.lit("")), first, F.lit(""))
    return text if whole else _shorten(text)


def rule_category(relative_dir: Column) -> Column:
    """Directory below the rules root without the folder that marks disabled rules; the top is ``root``."""
    bare = F.regexp_replace(relative_dir, r"_disabled[/\\]?", "")
    return F.when(bare == "", "root").otherwise(bare)


def rule_enabled(relative_dir: Column) -> Column:
    return ~F.array_contains(F.split(relative_dir, r"[/\\]"), "_disabled")
