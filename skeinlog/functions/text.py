"""Named column functions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import strings

# fixed values: characters kept before and after the first match of a snippet
SNIPPET_BEFORE = 40
SNIPPET_AFTER = 100

# fixed patterns: CSI, OSC (ended by BEL or ESC backslash), short ESC, 8-bit CSI, carriage return
TERMINAL_CONTROLS = (
    r"(?s)\x1b\[[^@-~]*[@-~]?"
    r"|\x1b\].*?(?:\x07|\x1b\\|\z)"
    r"|\x1b.?"
    r"|\x{9b}[^@-~]*[@-~]?"
    r"|\r"
)

# what a text with any of them holds
TERMINAL_MARKS = r"[\x1b\x{9b}\r]"

HAN = r"\p{IsHan}"
WORD_RUN = r"[\p{L}\p{N}]+"


def strip_terminal(text: Column) -> Column:
    return F.regexp_replace(text, TERMINAL_CONTROLS, "")


def readable_title(value: Column) -> Column:
    """Trimmed title, or null when it is empty or visibly mis-decoded."""
    t = strings.trim(value)
    marks = F.length(F.regexp_replace(t, r"[^?]", ""))
    broken = (t == "") | t.contains("�") | ((marks >= 3) & (marks * 5 >= F.length(t)))
    return F.when(~broken, t)


def fallback_title(thread_id: Column, *bodies: Column) -> Column:
    """First usable line of the bodies in order, else a short id."""

    def candidate(line: Column) -> Column:
        bare = F.regexp_replace(strings.trim(line), r"^#+", "")
        return strings.trim(F.regexp_replace(bare, r"^[-*]+", ""))

    def usable(line: Column) -> Column:
        return (line != "") & (line != "---") & ~line.startswith("<")

    firsts = [
        F.get(F.filter(F.transform(F.split(body, r"\r?\n"), candidate), usable), F.lit(0)) for body in bodies
    ]
    short = F.concat(F.lit("session "), F.left(thread_id, F.lit(8)))
    return F.coalesce(*firsts, short)


def snippet(text: Column, query: str) -> Column:
    """Context of the first match; without a match the head of the text."""
    width = len(query)
    pos = F.greatest(F.locate(query.lower(), F.lower(text)) - 1, F.lit(0))
    start = F.greatest(pos - SNIPPET_BEFORE, F.lit(0))
    end = F.least(pos + width + SNIPPET_AFTER, F.length(text))
    return F.concat(
        F.when(start > 0, "...").otherwise(""),
        F.substring(text, start + 1, end - start),
        F.when(end < F.length(text), "...").otherwise(""),
    )


def is_literal_query(query: Column) -> Column:
    """True when the text holds a character that is neither alphanumeric nor white space."""
    return query.rlike(r"[^\p{L}\p{N}\s]")


def raw_tokens(text: Column) -> Column:
    """Word runs in order, Han and other letters apart; a Han run becomes its characters and bigrams."""

    def expand(run: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(run))
        chars = F.transform(places, lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.transform(places, lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike(HAN), F.concat(chars, F.filter(pairs, lambda p: F.length(p) == 2))).otherwise(F.array(run))

    def runs(t: Column) -> Column:
        return F.regexp_extract_all(t, F.lit(WORD_RUN), F.lit(0))

    apart = F.regexp_replace(text, f"({HAN}+)", " $1 ")
    # one look at the text spares most texts a look at every word
    return F.when(text.rlike(HAN), F.flatten(F.transform(runs(apart), expand))).otherwise(runs(text))


def tokens(text: Column) -> Column:
    """Lower-cased index tokens in order."""
    return F.transform(raw_tokens(text), F.lower)


def may_hold(line: Column, query: str) -> Column:
    """False only for JSON lines none of whose strings can hold the query, decided before parsing.

    A run of ASCII letters stands in the raw line as in the decoded text, unless the line has Unicode escapes.
    """
    runs = re.findall("[a-z]{2,}", query.lower())
    if not runs:
        return F.lit(True)
    return F.contains(F.lower(line), F.lit(max(runs, key=len))) | F.contains(line, F.lit("\\u"))


def cut_bytes(text: Column, budget: Column) -> Column:
    """Longest prefix of at most ``budget`` UTF-8 bytes that ends on a character boundary.

    A UTF-8 sequence has at most 4 bytes, so stepping back at most 3 bytes reaches a boundary.
    """
    raw = F.encode(text, "UTF-8")

    def tail_is_whole(n: Column) -> Column:
        # a cut at n is on a boundary when the byte after it is not a continuation byte (10xxxxxx)
        nxt = F.hex(F.substring(raw, n + 1, F.lit(1)))
        return ~nxt.rlike("^[89AB]")

    n = budget.cast("int")
    cut = n
    for back in (3, 2, 1, 0):
        cut = F.when(tail_is_whole(n - back), n - back).otherwise(cut)
    return F.when(F.octet_length(text) <= budget, text).when(n <= 0, "").otherwise(F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8"))


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def highlight(text: Column, query: str) -> Column:
    """Escaped text with every case-insensitive match marked; queries of one character mark nothing."""
    safe = escape_html(text)
    if len(query) < 2:
        return safe
    quoted = re.escape(query.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    return F.regexp_replace(safe, f"(?iu)({quoted})", "<mark>$1</mark>")


def human_bytes(n: Column) -> Column:
    """Size in the largest unit it reaches; ties of the one decimal go to the even digit."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3

    def shown(unit: float) -> Column:
        return F.bround(n / F.lit(unit), 1)

    return (
        F.when(n >= gb, F.format_string("%.1f GB", shown(gb)))
        .when(n >= mb, F.format_string("%.1f MB", shown(mb)))
        .when(n >= kb, F.format_string("%.1f KB", shown(kb)))
        .otherwise(F.concat(n.cast("string"), F.lit(" B")))
    )


def human_tokens(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000_000, F.format_string("%.2fB", n / F.lit(1e9)))
        .when(n >= 1_000_000, F.format_string("%.2fM", n / F.lit(1e6)))
        .when(n >= 1_000, F.format_string("%.1fK", n / F.lit(1e3)))
        .otherwise(n.cast("string"))
    )


def human_usd(x: Column) -> Column:
    return (
        F.when(x >= 100, F.format_string("$%.0f", x))
        .when(x >= 1, F.format_string("$%.2f", x))
        .otherwise(F.format_string("$%.3f", x))
    )


def display_title(agent_title: Column, first_prompt: Column, placeholder: str = "(untitled)") -> Column:
    return F.coalesce(F.nullif(strings.trim(agent_title), F.lit("")), F.nullif(strings.trim(first_prompt), F.lit("")), F.lit(placeholder))


# --- paths and hosts -------------------------------------------------------------------------------

HOST_KEY = r"^@wsl:([^/]+)/(.*)$"
UNC_PATH = r"(?i)^//(?:wsl\.localhost|wsl\$)/([^/]+)(?:/|$)"


def decode_slug(slug: Column) -> Column:
    return F.concat(F.lit("/"), F.translate(slug, "-", "/"))


def comparable_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(path, "\\", "/"), "/+$", ""))


def tag_key(host: Column, user: Column, key: Column) -> Column:
    """Prefix a key with its host; a null host leaves it as it is."""
    owner = F.when(user.isNull(), host).otherwise(F.concat(host, F.lit("~"), user))
    return F.when(host.isNull(), key).otherwise(F.concat(F.lit("@wsl:"), owner, F.lit("/"), key))


def split_key(key: Column) -> Column:
    """(host, user, key); an untagged key has a null host."""
    owner = F.regexp_extract(key, HOST_KEY, 1)
    named = F.regexp_extract(owner, r"^([^~]+)~(.+)$", 1)
    tagged = owner != ""
    return F.struct(
        F.when(tagged, F.when(named != "", named).otherwise(owner)).alias("host"),
        F.when(tagged & (named != ""), F.regexp_extract(owner, r"^([^~]+)~(.+)$", 2)).alias("user"),
        F.when(tagged, F.regexp_extract(key, HOST_KEY, 2)).otherwise(key).alias("key"),
    )


def host_of_path(path: Column) -> Column:
    """Host name of a network path, null for a local one."""
    return F.nullif(F.regexp_extract(F.translate(path, "\\", "/"), UNC_PATH, 1), F.lit(""))


# --- display helpers for results ---------------------------------------------------------------------


def unwrap_read(text: Column) -> Column:
    """Body between the first opening and last closing content tag, newlines trimmed."""
    wrapped = r"(?s)<content>(.*)</content>"
    body = F.regexp_replace(F.regexp_extract(text, wrapped, 1), r"^\n+|\n+$", "")
    return F.when(text.rlike(wrapped), body).otherwise(text)


def shell_output(raw: Column) -> Column:
    """(body, exit_code, duration_ms, lifted) of a shell result that starts with its status lines."""
    parts = F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n", 4)
    marked = strings.ltrim(F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).startswith("Output:")
    # the plain prefix test comes first: other results are never split
    lifted = F.when(raw.startswith("Exit code:"), marked).otherwise(False)
    code = strings.trim(F.replace(F.get(parts, F.lit(0)), F.lit("Exit code:"), F.lit("")))
    wall = strings.trim(F.replace(F.replace(F.get(parts, F.lit(1)), F.lit("Wall time:"), F.lit("")), F.lit("seconds"), F.lit("")))
    return F.struct(
        F.when(lifted, F.coalesce(F.get(parts, F.lit(3)), F.lit(""))).otherwise(raw).alias("body"),
        F.when(lifted, code.try_cast("bigint")).alias("exit_code"),
        F.when(lifted, (wall.try_cast("double") * 1000).try_cast("bigint")).alias("duration_ms"),
        lifted.alias("lifted"),
    )


def separate_stderr(stdout: Column, stderr: Column) -> Column:
    return (F.coalesce(stderr, F.lit("")) != "") & ~F.contains(F.coalesce(stdout, F.lit("")), F.coalesce(stderr, F.lit("")))


def fetch_ok(code: Column) -> Column:
    return code.isNull() | code.between(200, 399)


def file_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strings.trim), lambda p: p != "")


def patch_line_kind(line: Column) -> Column:
    """file / marker / hunk / add / del / ctx class of one patch line."""
    header = line.rlike(r"^\*\*\* (Add|Update|Delete|Move) ")
    return (
        F.when(line.startswith("*** "), F.when(header, "file").otherwise("marker"))
        .when(line.rlike(r"^(Index: |--- |\+\+\+ )"), "file")
        .when(line.startswith("===="), "marker")
        .when(line.startswith("@@"), "hunk")
        .when(line.startswith("+"), "add")
        .when(line.startswith("-"), "del")
        .otherwise("ctx")
    )
