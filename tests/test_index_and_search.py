import pytest

from skeinlog.plans import index as I
from skeinlog.plans import search as S


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(
        [
            ("k1", "claude", "alpha-1", None, "p", "/work/alpha", "Fix parser", "please fix", "2026-01-03 00:00:00"),
            ("k2", "claude", "beta-2", None, "p", "/work/beta", None, "hello world", "2026-01-02 00:00:00"),
            ("k3", "codex", "gamma-3", None, "p", "/work/gamma", None, None, "2026-01-01 00:00:00"),
            ("k4", "codex", "old-4", "snap", "p", "/work/old", None, "archived parser", "2026-01-04 00:00:00"),
        ],
        "session_key string, source string, session_id string, archive_name string, project string, project_path string, agent_title string, first_prompt string, modified string",
    )
    texts = spark.createDataFrame(
        [
            ("k1", 0, 0, "content", "the parser fails on input"),
            ("k1", 1, 0, "tool", "secretword in tool output"),
            ("k2", 0, 0, "content", "unrelated parsers and fails"),
            ("k3", 0, 0, "content", "preparserfoo embedded"),
            ("k3", 1, 0, "reasoning", "thinking about fails"),
        ],
        "session_key string, unit bigint, seq bigint, kind string, text string",
    )
    return I.read_index(spark, I.write_index(docs, texts))


def keys(df):
    return [r.session_key for r in df.collect()]


def test_more_tokens_rank_higher_then_recency(index):
    assert keys(S.token_search(index, "parser fails")) == ["k1", "k2"]
    assert keys(S.token_search(index, "fails", ["content", "reasoning"])) == ["k1", "k2", "k3"]


def test_scopes_archives_and_sources(index):
    assert keys(S.token_search(index, "secretword")) == []
    assert keys(S.token_search(index, "secretword", ["tool"])) == ["k1"]
    assert keys(S.search(index, "archived", archive_scope="archived")) == ["k4"]
    assert keys(S.search(index, "fails", source="codex")) == []


def test_fusion_adds_substrings_after_tokens(index):
    rows = S.search(index, "parser").collect()
    assert [r.session_key for r in rows] == ["k1", "k2", "k3"]
    assert [r.score for r in rows] == [1, 0, 0]
    assert keys(S.search(index, "parser", limit=1)) == ["k1"]


def test_literal_query_and_field_order(index):
    rows = S.search(index, "beta-2").collect()
    assert [(r.session_key, r.snippet) for r in rows] == [("k2", "beta-2")]
    assert [r.snippet for r in S.substring_search(index, "/work/a").collect()] == ["/work/alpha"]


def test_blank_query_browses(index):
    rows = S.search(index, "  ").collect()
    assert [(r.session_key, r.snippet) for r in rows] == [("k1", "please fix"), ("k2", "hello world"), ("k3", "/work/gamma")]


def test_no_bound_is_broken(index):
    assert {r.broken for r in I.violations(index).collect()} == {0}


def test_scope_codes():
    assert S.scope_codes(None) == [0] and S.scope_codes(["tool", "reasoning"]) == [1, 2] and S.scope_codes(["other"]) == [0]


def test_texts_and_tokens_are_kept_whole(spark):
    docs = spark.createDataFrame([("k", "claude", "sid", None, "/p", None, None, "m")], "session_key string, source string, session_id string, archive_name string, project_path string, agent_title string, first_prompt string, modified string")
    words = [f"w{i:05d}" for i in range(3000)]
    rows = [("k", 0, 0, "content", " ".join(words)), ("k", 1, 0, "tool", "x" * 200_000), ("k", 2, 0, "tool", " "), *[("k", i, 0, "reasoning", f"abc中文 t{i}") for i in range(3, 300)]]
    index = I.read_index(spark, I.write_index(docs, spark.createDataFrame(rows, "session_key string, unit bigint, seq bigint, kind string, text string")))
    assert sorted((r.unit, r.text) for r in index.texts.collect()) == sorted((r[1], r[4]) for r in rows if r[4].strip())
    got = {(r.code, r.token) for r in index.postings.collect()}
    assert got == {(0, w) for w in [*words, "p", "sid"]} | {(1, "x" * 200_000)} | {(2, t) for t in ["abc", "中", "文", "中文", *[f"t{i}" for i in range(3, 300)]]}
    assert keys(S.token_search(index, "abc", ["reasoning"])) == ["k"]
