"""Search over a stored index, and exhaustive search over all texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.plans.dashboard import browse
from skeinlog.plans.index import Index, kind_code
from skeinlog.plans.scope import in_scope

DOC_COLUMNS = ["session_key", "source", "session_id", "archive_name", "modified"]


def scope_codes(kinds: Sequence[str] | None) -> list[int]:
    """Kind codes of the selected scopes; none selected means content only."""
    codes = {"tool": 1, "reasoning": 2}
    return sorted({codes.get(k, 0) for k in kinds or []}) or [0]


def query_tokens(df: DataFrame, query: str) -> list[str]:
    """Tokens of the query text, by the same expression that built the index."""
    return df.sparkSession.range(1).select(X.tokens(F.lit(query)).alias("t")).first()["t"]


def is_literal(query: str) -> bool:
    return any(not c.isalnum() and not c.isspace() for c in query)


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def _has(c: Column | str, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(query)), F.lit(False))


def _first_text(index: Index, query: str, codes: list[int], among: DataFrame) -> DataFrame:
    """First text of a session that holds the whole query, as its snippet; only sessions of ``among`` are read."""
    hits = index.texts.where(F.col("code").isin(codes) & _has("text", query)).join(among.select("session_key"), "session_key", "left_semi")
    return (
        hits.select("session_key", "unit", "seq", X.snippet(F.col("text"), query).alias("snippet"))
        .groupBy("session_key")
        .agg(F.min_by("snippet", F.struct("unit", "seq")).alias("text_snippet"))
    )


def token_scores(index: Index, docs: DataFrame, tokens: list[str], codes: list[int]) -> DataFrame:
    """Number of distinct query tokens per in-scope session. The token list is pushed into the scan."""
    wanted = index.postings.where(F.col("token").isin(tokens) & F.col("code").isin(codes))
    scores = wanted.select("session_key", "token").distinct().groupBy("session_key").agg(F.count("*").alias("score"))
    return docs.join(scores, "session_key")


def token_search(index: Index, query: str, scopes=None, source=None, archive_scope=None, limit: int | None = None) -> DataFrame:
    """Any token matches; more distinct tokens rank higher, then newer sessions. Without a limit every match is returned."""
    codes = scope_codes(scopes)
    q = query.strip().lower()
    docs = in_scope(index.docs, archive_scope, source)
    scored = token_scores(index, docs, query_tokens(index.docs, q), codes)
    order = [F.col("score").desc(), F.col("modified").desc_nulls_last(), F.col("source"), F.col("session_id")]
    top = scored if limit is None else scored.orderBy(*order).limit(limit)
    return _with_snippet(index, top, q, codes).orderBy(*order)


def _with_snippet(index: Index, top: DataFrame, q: str, codes: list[int]) -> DataFrame:
    """Snippet of a token hit: a text with the whole query, else the path, title or prompt."""
    shown = top.join(_first_text(index, q, codes, top), "session_key", "left")
    snippet = F.coalesce(
        "text_snippet",
        F.when(_has("project_path", q), F.col("project_path")),
        F.when(_has("agent_title", q), F.col("agent_title")),
        "first_prompt",
        "project_path",
    )
    return shown.select(*DOC_COLUMNS, "score", snippet.alias("snippet"))


def substring_matches(index: Index, q: str, codes: list[int], docs: DataFrame) -> DataFrame:
    """Every in-scope session that holds the text; path, id, title and prompt count as content."""
    meta = F.lit(0 in codes)
    joined = docs.join(_first_text(index, q, codes, docs), "session_key", "left")
    snippet = F.coalesce(
        *[F.when(meta & _has(f, q), F.col(f)) for f in ("project_path", "session_id", "agent_title", "first_prompt")],
        F.col("text_snippet"),
    )
    return joined.withColumn("snippet", snippet).where("snippet is not null").select(*DOC_COLUMNS, F.lit(0).cast("bigint").alias("score"), "snippet")


def substring_search(index: Index, query: str, scopes=None, source=None, archive_scope=None, limit: int | None = None) -> DataFrame:
    q = query.strip().lower()
    rows = substring_matches(index, q, scope_codes(scopes), in_scope(index.docs, archive_scope, source))
    return _first(rows.orderBy("source", "session_id", "session_key"), limit)


def search(index: Index, query: str, scopes=None, source=None, archive_scope=None, limit: int | None = None) -> DataFrame:
    """Blank queries browse, literal ones match substrings, others rank token hits and fill up with substrings."""
    q = query.strip().lower()
    if not q:
        rows = browse(index.docs, archive_scope, source, limit)
        return rows.select(*DOC_COLUMNS, F.lit(0).cast("bigint").alias("score"), "snippet")
    words = [] if is_literal(q) else query_tokens(index.docs, q)
    if not words:
        return substring_search(index, q, scopes, source, archive_scope, limit)
    codes = scope_codes(scopes)
    docs = in_scope(index.docs, archive_scope, source)
    ranked = _with_snippet(index, token_scores(index, docs, words, codes), q, codes).withColumn("tier", F.lit(0))
    rest = substring_matches(index, q, codes, docs).join(ranked.select("session_key"), "session_key", "left_anti").withColumn("tier", F.lit(1))
    order = [F.col("tier"), F.col("score").desc(), F.when(F.col("tier") == 0, F.col("modified")).desc_nulls_last(), F.col("source"), F.col("session_id")]
    return _first(ranked.unionByName(rest).orderBy(*order), limit).drop("tier")


def deep_search(docs: DataFrame, hits: DataFrame, source=None, archive_scope=None, limit: int | None = None) -> DataFrame:
    """Exhaustive search: the first hit of every in-scope session, newest sessions first.

    ``hits(session_key, unit, seq, snippet)`` come from the whole texts, not from the index.
    """
    first = hits.groupBy("session_key").agg(F.min_by("snippet", F.struct("unit", "seq")).alias("snippet"))
    rows = in_scope(docs, archive_scope, source).join(first, "session_key")
    return _first(rows.select(*DOC_COLUMNS, "snippet").orderBy(F.col("modified").desc_nulls_last(), "source", "session_id"), limit)


def text_hits(texts: DataFrame, query: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """Hits over unbounded texts."""
    q = query.strip().lower()
    rows = texts if kinds is None else texts.where(kind_code("kind").isin(scope_codes(kinds)))
    return rows.where(_has("text", q)).select("session_key", "unit", "seq", X.snippet(F.col("text"), q).alias("snippet"))


def indexed_hits(index: Index, query: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """Hits over the whole texts of an index; one that was opened for a scope reads only that scope's files."""
    q = query.strip().lower()
    rows = index.texts if kinds is None else index.texts.where(F.col("code").isin(scope_codes(kinds)))
    return rows.where(_has("text", q)).select("session_key", "unit", "seq", X.snippet(F.col("text"), q).alias("snippet"))
