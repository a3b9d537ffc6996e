"""Open texts of a stream: carried only for their own session, given out when it goes quiet, replayed without a trace."""

import json

import pytest

from skeinlog.session import scratch_path
from skeinlog.streaming import turns


def said(text, minute, closes=False):
    return json.dumps({"type": "assistant", "timestamp": f"2026-01-01T10:{minute:02d}:00Z", "message": {"stop_reason": "end_turn" if closes else None, "content": [{"type": "text", "text": text}]}})


@pytest.fixture
def feed(spark, as_lines):
    path = scratch_path(spark, "turns")
    write = turns.merge_into(path, "5 minutes", merge_every=3)

    def run(batch_id, sessions, start=0):
        rows = as_lines({s: ["{}"] * start + lines for s, lines in sessions.items()}).where(f"off >= {start}")
        write(rows, batch_id)
        held = turns.state(spark, path).live("open")
        return {r.session_id: r.text for r in held.collect()}

    run.closed = lambda: sorted((r.session_id, r.content) for r in turns.closed_turns(spark, path).collect())
    run.store = turns.state(spark, path)
    return run


def test_a_quiet_session_gives_its_text_and_leaves_the_state(feed):
    assert feed(0, {"a": [said("one ", 0)], "b": [said("x ", 1), said("y", 2, True)]}) == {"a": "one "}
    assert feed(1, {"b": [said("z ", 3)]}, 5) == {"a": "one ", "b": "z "}
    # only what the batch touched is written again
    assert [r.session_id for r in feed.store.table("open").where("segment = 2").collect()] == ["b"]
    assert feed(2, {"a": [said("two ", 4)]}, 5) == {"a": "one two ", "b": "z "}
    assert feed.closed() == [("b", "x y")]
    # the newest time runs ahead of both sessions
    assert feed(3, {"c": [said("late", 30, True)]}) == {}
    assert feed.closed() == [("a", "one two "), ("b", "x y"), ("b", "z "), ("c", "late")]
    assert feed(4, {"a": [said("again", 31, True)]}, 9) == {}
    assert ("a", "again") in feed.closed()


def test_a_replayed_batch_leaves_state_and_turns_alone(feed):
    feed(0, {"a": [said("one ", 0)]})
    held = feed(1, {"a": [said("two ", 1)]}, 5)
    before = feed.closed()
    assert feed(1, {"a": [said("two ", 1)]}, 5) == held == {"a": "one two "}
    assert feed(0, {"a": [said("other", 0, True)]}) == held and feed.closed() == before


def test_the_state_is_merged_into_one_segment(feed):
    for i in range(3):
        held = feed(i, {f"s{i}": [said(f"{i} ", i)]})
    assert feed.store.committed() == [5] and held == {"s0": "0 ", "s1": "1 ", "s2": "2 "}
    assert feed(3, {"s1": [said("more", 3, True)]}, 5) == {"s0": "0 ", "s2": "2 "}
    assert feed.closed() == [("s1", "1 more")]
