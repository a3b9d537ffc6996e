"""One document per top session, and its texts, over every dialect: what the index is built from.

``docs(session_key, source, session_id, archive_name, project, project_path, agent_title, first_prompt, modified)`` and
``texts(session_key, source, archive_name, member, unit, seq, kind, text)``. A text's place is (member, unit, seq): ``member`` orders the threads of a
group, root first, and is empty elsewhere; ``seq`` is text, because the relational dialect orders parts by their id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skeinlog.session import cut_lineage
from skeinlog.sources import dialect_a, dialect_b, dialect_c, dialect_d

DOC_COLUMNS = ["session_key", "source", "session_id", "archive_name", "project", "project_path", "agent_title", "first_prompt", "modified"]
TEXT_COLUMNS = ["session_key", "source", "archive_name", "member", "unit", "seq", "kind", "text"]


@dataclass(frozen=True)
class Parsed:
    """Documents and texts of some sessions of one source."""

    docs: DataFrame
    texts: DataFrame


def session_key(source: str, session_id: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), session_id)


def archive_part(session_id: Column) -> Column:
    """Snapshot name of an archived session's id, null for a live one."""
    return F.nullif(F.regexp_extract(session_id, r"^(.+)/[^/]+$", 1), F.lit(""))


def _missing() -> Column:
    return F.lit(None).cast("string")


def _doc(source: str, rows: DataFrame, key: str, **fields: Column | str) -> DataFrame:
    sid = F.col(key)
    given = {"project": _missing(), "agent_title": _missing(), "first_prompt": _missing(), "modified": _missing(), **{k: F.col(v) if isinstance(v, str) else v for k, v in fields.items()}}
    known = {"session_key": session_key(source, sid), "source": F.lit(source), "session_id": sid, "archive_name": archive_part(sid), **given}
    return rows.select(*[known[c].alias(c) for c in DOC_COLUMNS])


def _text(source: str, rows: DataFrame, key: str, member: Column | None = None) -> DataFrame:
    sid = F.col(key)
    seq = F.col("seq") if rows.schema["seq"].dataType.simpleString() == "string" else F.lpad(F.col("seq").cast("string"), 10, "0")
    place = [(F.lit("") if member is None else member).alias("member"), F.col("unit").cast("bigint").alias("unit"), seq.alias("seq")]
    return rows.select(session_key(source, sid).alias("session_key"), F.lit(source).alias("source"), archive_part(sid).alias("archive_name"), *place, "kind", "text")


def of_messages(lines: DataFrame, counts: Observation | None = None) -> Parsed:
    source = dialect_a.SOURCE
    docs = _doc(source, dialect_a.sessions(lines), "session_id", project_path="project_path", agent_title="agent_title", first_prompt="first_prompt", modified="updated_at")
    return Parsed(docs, _text(source, dialect_a.texts(lines, counts), "session_id"))


def of_envelopes(lines: DataFrame, tree: DataFrame, counts: Observation | None = None) -> Parsed:
    """Thread groups on their root; the first prompt is the root's, else that of the earliest child that has one.

    ``tree`` are resolved threads (``dialect_b.threads`` or a stored forest). Only narrow columns of the files meet it, never their lines.
    """
    source = dialect_b.SOURCE
    # parsed once, for the documents and the texts
    entries = cut_lineage(dialect_b.entries(lines, counts), "envelope-entries")
    place = F.struct((F.col("thread_id") != F.col("root_id")).alias("is_child"), "started", "thread_id")
    members = tree.select("session_id", "root_id", place.alias("place"), F.when(F.col("thread_id") == F.col("root_id"), F.col("cwd")).alias("cwd"))
    rows = members.join(dialect_b.session_facts(entries), "session_id", "left")
    prompted = F.when(F.col("first_prompt").isNotNull(), F.col("place"))
    groups = rows.groupBy("root_id").agg(F.min_by("first_prompt", prompted).alias("first_prompt"), F.max("updated_at").alias("modified"), F.min_by("cwd", "place").alias("cwd"))
    docs = _doc(source, groups, "root_id", project_path="cwd", first_prompt="first_prompt", modified="modified")
    owned = dialect_b.group_texts(entries.where("text is not null"), tree).withColumnRenamed("session_key", "root_id")
    member = F.concat_ws(" ", F.col("member.is_child").cast("int").cast("string"), F.coalesce("member.started", F.lit("")), "member.thread_id")
    return Parsed(docs, _text(source, owned, "root_id", member))


def of_relations(sessions: DataFrame, messages: DataFrame, parts: DataFrame, roots: DataFrame, counts: Observation | None = None) -> Parsed:
    """Root sessions that are listed, with the texts of everything below them."""
    source = dialect_c.SOURCE
    listed = dialect_c.session_list(sessions, messages).join(dialect_c.index_first_prompt(parts, roots), "session_id", "left")
    docs = _doc(source, listed, "session_id", project_path="project_path", agent_title="agent_title", first_prompt="first_prompt", modified="updated_at")
    top = sessions.where("parent_id is null").select(F.col("id").alias("root_id"))
    owners = roots.join(top, "root_id", "left_semi")
    owned = dialect_c.texts(parts, counts).join(owners, "session_id")
    return Parsed(docs, _text(source, owned, "root_id"))


def of_trees(lines: DataFrame, counts: Observation | None = None) -> Parsed:
    source = dialect_d.SOURCE
    docs = _doc(source, dialect_d.sessions(lines), "session_id", project_path="project_path", agent_title="agent_title", first_prompt="first_prompt", modified="updated_at")
    return Parsed(docs, _text(source, dialect_d.texts(lines, counts), "session_id"))


def union(parts: list[Parsed]) -> Parsed:
    docs, texts = parts[0].docs, parts[0].texts
    for p in parts[1:]:
        docs, texts = docs.unionByName(p.docs), texts.unionByName(p.texts)
    return Parsed(docs, texts)


class LineCounts:
    """Lines read and lines that are no JSON, per source, observed while the lines are parsed for something else.

    Known once what was parsed has been written; a task that is run again may count its lines again.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def of(self, source: str) -> Observation:
        return self._seen.setdefault(source, Observation(f"lines of {source}"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """(source, lines, failed); waits for what is still being written."""
        found = [(source, o.get["lines"], o.get["failed"]) for source, o in sorted(self._seen.items())]
        return spark.createDataFrame(found, "source string, lines bigint, failed bigint")


def _counted(counts: LineCounts | None, source: str) -> Observation | None:
    return None if counts is None else counts.of(source)


# From the keys (source, session_id) that changed to their documents and texts, freshly parsed.
Parser = Callable[[DataFrame], Parsed]


def _semi(rows: DataFrame, keys: DataFrame, on: str, key: str) -> DataFrame:
    return rows.join(keys.select(F.col(key).alias(on)), on, "left_semi")


def line_parser(lines: dict[str, DataFrame], counts: LineCounts | None = None) -> Parser:
    """Re-parse the changed sessions of the dialects whose session is one file; only their lines pass the semi-join and reach a parser."""
    readers = {dialect_a.SOURCE: of_messages, dialect_d.SOURCE: of_trees}

    def parse(keys: DataFrame) -> Parsed:
        return union([readers[s](_semi(rows, keys.where(F.col("source") == s), "session_id", "session_id"), _counted(counts, s)) for s, rows in lines.items()])

    return parse


def group_parser(lines: DataFrame, tree: DataFrame, counts: LineCounts | None = None) -> Parser:
    """Re-parse the thread groups whose root is named; their members' lines are read, no others.

    If most files are named, as when an index is built, no line is shuffled to drop the others: all are parsed where they lie, and only what they give
    meets the members. Lines that are counted are those of members only.
    """

    def parse(keys: DataFrame) -> Parsed:
        members = cut_lineage(_semi(tree, keys.where(F.col("source") == dialect_b.SOURCE), "root_id", "session_id"), "group-members")
        most = counts is None and 2 * members.count() >= tree.count()
        named = lines if most else _semi(lines, members, "session_id", "session_id")
        return of_envelopes(named, members, _counted(counts, dialect_b.SOURCE))

    return parse


def relation_parser(sessions: DataFrame, messages: DataFrame, parts: DataFrame, roots: DataFrame, counts: LineCounts | None = None) -> Parser:
    """Re-parse the root sessions that are named, with everything below them."""

    def parse(keys: DataFrame) -> Parsed:
        owned = _semi(roots, keys.where(F.col("source") == dialect_c.SOURCE), "root_id", "session_id")
        below = lambda rows, on: _semi(rows, owned, on, "session_id")
        return of_relations(below(sessions, "id"), below(messages, "session_id"), below(parts, "session_id"), owned, _counted(counts, dialect_c.SOURCE))

    return parse


def any_parser(*parsers: Parser) -> Parser:
    return lambda keys: union([p(keys) for p in parsers])
