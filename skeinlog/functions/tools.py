"""Display facts of tool calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.functions import variants as V

# fixed values: tool name to label
TOOL_LABELS = {
    "WebFetch": "Web fetch",
    "WebSearch": "Web search",
    "AskUserQuestion": "Ask user",
    "Bash": "Terminal",
    "PowerShell": "Terminal",
    "Monitor": "Monitor task",
    "BashOutput": "Terminal output",
    "Edit": "Edit file",
    "Write": "Write file",
    "MultiEdit": "Multi-edit",
    "NotebookEdit": "Edit notebook",
    "Read": "Read file",
    "Glob": "Find files",
    "Grep": "Search content",
    "TodoWrite": "Todo list",
    "shell_command": "Terminal",
    "update_plan": "Update plan",
    "apply_patch": "Apply patch",
    "web_search": "Web search",
    "ask_user_question": "Ask user",
    "bash": "Terminal",
    "interactive_bash": "Interactive shell",
    "background_output": "Background output",
    "read": "Read file",
    "edit": "Edit file",
    "write": "Write file",
    "glob": "Find files",
    "grep": "Search content",
    "codesearch": "Code search",
    "webfetch": "Web fetch",
    "websearch": "Web search",
    "todowrite": "Todo list",
    "task": "Subagent",
    "question": "Ask user",
    "patch": "File patch",
    "skill": "Skill",
    "Agent": "Subagent",
    "Task": "Subagent",
    "ExitPlanMode": "Exit plan mode",
    "Workflow": "Workflow",
    "ToolSearch": "Tool search",
    "ScheduleWakeup": "Schedule wakeup",
    "TaskCreate": "Create task",
    "TaskUpdate": "Update task",
    "TaskGet": "Get task",
    "TaskStop": "Stop task",
    "Skill": "Skill",
    "SlashCommand": "Slash command",
}
FALLBACK_LABEL = "Tool"
# fixed values: input fields that may summarise a call, in order
SUMMARY_KEYS = ["url", "command", "pattern", "query", "path", "prompt"]


def tool_label(name: Column) -> Column:
    """Registered label, ``server · tool`` of an ``mcp__`` name, else the name itself."""
    known = F.create_map(*[F.lit(x) for pair in TOOL_LABELS.items() for x in pair])
    mcp = F.replace(F.regexp_replace(name, "^mcp__", ""), F.lit("__"), F.lit(" · "))
    return (
        F.when(F.coalesce(name, F.lit("")) == "", FALLBACK_LABEL)
        .otherwise(F.coalesce(F.try_element_at(known, name), F.when(name.startswith("mcp__"), mcp), name))
    )


def call_summary(tool_input: Column) -> Column:
    """Last two segments of the file path, else the first line of the first summary field."""
    v = V.parse(tool_input)
    path = V.get(v, "$.file_path")
    parts = F.split(path, r"[/\\]")
    tail = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    first = F.coalesce(*[V.get(v, f"$.{k}") for k in SUMMARY_KEYS])
    return F.when(F.coalesce(path, F.lit("")) != "", tail).otherwise(F.substring_index(first, "\n", 1))


def todo_counts(tool_input: Column) -> Column:
    """(completed, in_progress, open) counts of a to-do call; any other status is open."""
    todos = F.coalesce(
        F.transform(V.array(V.parse(tool_input), "$.todos"), lambda t: F.coalesce(V.get(t, "$.status"), F.lit(""))),
        F.expr("cast(array() as array<string>)"),
    )

    def n(cond) -> Column:
        return F.size(F.filter(todos, cond)).cast("bigint")

    return F.struct(
        n(lambda s: s == "completed").alias("completed"),
        n(lambda s: s == "in_progress").alias("in_progress"),
        n(lambda s: ~s.isin("completed", "in_progress")).alias("open"),
    )


def call_parameters(tool_input: Column) -> Column:
    """Key, value and long flag (over 80 characters) of every input field."""
    fields = F.try_variant_get(V.parse(tool_input), "$", "map<string,variant>")

    def value(v: Column) -> Column:
        return F.coalesce(V.get(v, "$"), F.lit("null"))

    return F.transform(
        F.map_entries(fields),
        lambda e: F.struct(e["key"].alias("key"), value(e["value"]).alias("value"), (F.length(value(e["value"])) > 80).alias("long")),
    )


def is_selected(answers: Column, label: Column) -> Column:
    """The label is an answer, or one of the comma-separated parts of an answer."""
    return F.exists(answers, lambda a: (a == label) | F.array_contains(F.split(a, r",\s*"), label))


def custom_answers(answers: Column, labels: Column) -> Column:
    """Free-text answers: neither a label nor a list made of labels only."""

    def free(a: Column) -> Column:
        parts = F.split(a, r",\s*")
        all_known = (F.size(parts) > 1) & F.forall(parts, lambda p: F.array_contains(labels, p))
        return ~F.array_contains(labels, a) & ~all_known

    return F.filter(answers, free)


def clean_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strings.trim), lambda t: t != "")
