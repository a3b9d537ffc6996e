"""Column contracts shared by every dialect."""

from __future__ import annotations

# One source line (or relational message) per row. ``off`` orders the units of a session; ``chunk``
# is a bounded slice of that order, used to keep ordered operators parallel inside one session.
LINE_COLUMNS = ["session_id", "chunk", "off", "line"]

RECORD_COLUMNS = [
    "session_id",
    "chunk",
    "unit",
    "seq",
    "record_type",
    "level",
    "content",
    "ts",
    "tool_name",
    "tool_use_id",
    "tool_input",
    "group_id",
    "result_meta",
    "diff",
]

TEXT_COLUMNS = ["session_id", "chunk", "unit", "seq", "kind", "text"]

USAGE_COLUMNS = ["input_tokens", "output_tokens", "cache_tokens", "total_tokens"]
