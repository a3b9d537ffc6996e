"""The segmented index: refresh, replay, crash before the commit, merging, scope pruning, versions of the layout."""

import json

import pytest
from skeinlog.plans import documents as D
from skeinlog.plans import search as S
from skeinlog.plans import segments as G
from skeinlog.session import scratch_path
from skeinlog.streaming.refresh import refresh_into


def line(role, text):
    return json.dumps({"type": role, "timestamp": "2026-01-01T10:00:00Z", "message": {"role": role, "content": [{"type": "text", "text": text}]}})


@pytest.fixture
def store(spark):
    return G.Store(spark, scratch_path(spark, "segments"))


@pytest.fixture
def notices(spark):
    def make(*rows):
        return spark.createDataFrame([("claude", *r, i) for i, r in enumerate(rows)], "source string, session_id string, version string, seen int")

    return make


def changed(rows):
    return rows.drop("seen")


def state(store):
    index = G.open_index(store)
    texts = sorted((r.session_key, r.text) for r in index.texts.collect())
    return sorted(r.session_key for r in index.docs.collect()), texts, sorted((r.token, r.session_key) for r in index.postings.collect())


def parser(as_lines, sessions, calls=None):
    parse = D.line_parser({"claude": as_lines({s: [line("user", t) for t in texts] for s, texts in sessions.items()})})

    def counted(keys):
        if calls is not None:
            calls.append(sorted(r.session_id for r in keys.collect()))
        return parse(keys)

    return counted


def test_only_what_changed_is_parsed_and_replaced(store, notices, as_lines):
    calls = []
    G.refresh(store, 0, changed(notices(("a", "1"), ("b", "1"), ("snap/c", "1"))), parser(as_lines, {"a": ["alpha"], "b": ["beta"], "snap/c": ["gamma"]}, calls))
    G.refresh(store, 2, changed(notices(("a", "2"), ("b", "1"), ("d", "1"))), parser(as_lines, {"a": ["alpha two"], "b": ["never read"], "d": ["delta"]}, calls))
    G.refresh(store, 4, changed(notices(("snap/c", None), ("gone", None))), parser(as_lines, {}, calls))
    assert calls == [["a", "b", "snap/c"], ["a", "d"], []]
    docs, texts, postings = state(store)
    assert docs == ["claude:a", "claude:b", "claude:d"]
    assert texts == [("claude:a", "alpha two"), ("claude:b", "beta"), ("claude:d", "delta")]
    assert ("two", "claude:a") in postings and not any(k == "claude:snap/c" for _, k in postings)
    assert {(r.session_id, r.version) for r in store.versions().collect()} == {("a", "2"), ("b", "1"), ("d", "1")}
    # a session that comes back after it was deleted
    G.refresh(store, 6, changed(notices(("snap/c", "3"))), parser(as_lines, {"snap/c": ["again"]}))
    assert ("claude:snap/c", "again") in state(store)[1]


def test_a_replayed_batch_changes_nothing(store, notices, as_lines):
    write = refresh_into(store, lambda: parser(as_lines, {"a": ["alpha"], "b": ["beta"]}))
    write(notices(("a", "1"), ("b", "1"), ("b", "2")), 0)
    write(notices(("a", "2")), 1)
    before, segments = state(store), store.committed()
    assert {(r.session_id, r.version) for r in store.versions().collect()} == {("a", "2"), ("b", "2")}
    for batch in (0, 1):
        write(notices(("a", f"replayed {batch}")), batch)
    assert state(store) == before and store.committed() == segments


def test_a_refresh_that_dies_before_its_commit_leaves_nothing(store, notices, as_lines, monkeypatch):
    G.refresh(store, 0, changed(notices(("a", "1"))), parser(as_lines, {"a": ["alpha"]}))
    before = state(store)
    with monkeypatch.context() as m:
        m.setattr(G, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            G.refresh(store, 2, changed(notices(("a", "2"))), parser(as_lines, {"a": ["half"]}))
    assert state(store) == before
    G.refresh(store, 2, changed(notices(("a", "2"))), parser(as_lines, {"a": ["whole"]}))
    assert state(store)[1] == [("claude:a", "whole")]


def test_merging_keeps_the_live_rows(store, notices, as_lines):
    G.refresh(store, 0, changed(notices(("a", "1"), ("b", "1"))), parser(as_lines, {"a": ["alpha"], "b": ["beta"]}))
    G.refresh(store, 2, changed(notices(("a", "2"), ("b", None))), parser(as_lines, {"a": ["second"]}))
    before = state(store)
    G.merge(store, 3)
    assert store.committed() == [3] and state(store) == before
    assert store.visible("tombstones").count() == 0
    assert G.vacuum(store) == [0, 2] and state(store) == before
    assert {r.segment for name in ("docs", "texts", "postings", "versions") for r in store.table(name).select("segment").distinct().collect()} == {3}
    G.merge(store, 3)
    G.refresh(store, 4, changed(notices(("a", "2"), ("c", "1"))), parser(as_lines, {"c": ["third"]}))
    assert state(store)[1] == [("claude:a", "second"), ("claude:c", "third")]
    # a batch from before the merge is still known as done
    G.refresh(store, 2, changed(notices(("a", "9"))), parser(as_lines, {"a": ["old batch"]}))
    assert state(store)[1] == [("claude:a", "second"), ("claude:c", "third")]


def test_a_whole_manifest_gives_new_changed_and_deleted(store, notices, as_lines):
    G.refresh(store, 0, changed(notices(("a", "1"), ("b", "1"), ("c", "1"))), parser(as_lines, {k: [k] for k in "abc"}))
    diff = G.changes(store, changed(notices(("a", "1"), ("b", "2"), ("d", "1"))))
    assert sorted((r.session_id, r.version) for r in diff.collect()) == [("b", "2"), ("c", None), ("d", "1")]


def test_segments_of_another_layout_are_rebuilt(store, notices, as_lines, monkeypatch):
    G.refresh(store, 0, changed(notices(("a", "1"))), parser(as_lines, {"a": ["old"]}))
    monkeypatch.setattr(G, "SCHEMA_VERSION", G.SCHEMA_VERSION + 1)
    assert state(store)[0] == []
    G.refresh(store, 2, changed(notices(("a", "1"))), parser(as_lines, {"a": ["new"]}))
    assert state(store)[1] == [("claude:a", "new")]


def test_the_scope_prunes_files_of_every_table(store, notices, as_lines):
    G.refresh(store, 0, changed(notices(("a", "1"), ("snap/c", "1"))), parser(as_lines, {"a": ["alpha"], "snap/c": ["alpha too"]}))
    index = G.open_index(store, None, "claude")
    for rows in (index.docs, index.texts, index.postings):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert "archive_name" in filters and "source" in filters and "segment" in filters
    assert [r.session_key for r in S.token_search(index, "alpha").collect()] == ["claude:a"]
    archived = G.open_index(store, "archived")
    assert [r.session_key for r in S.search(archived, "alpha", archive_scope="archived").collect()] == ["claude:snap/c"]


def test_an_empty_index_answers(store):
    assert state(store) == ([], [], [])
    G.merge(store, 1)
    assert store.committed() == []
