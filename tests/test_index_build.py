"""What building the index of all sources does only once: pointers, envelope lines, postings."""

import json

from pyspark.sql import functions as F

from skeinlog.operators.tree import next_pointers, resolve_roots
from skeinlog.plans import documents as D
from skeinlog.plans import segments as G
from skeinlog.sources import dialect_b as B
from workload import fixture_b

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def said(kind, payload, ts="2026-01-01T10:00:00Z"):
    return json.dumps({"type": kind, "timestamp": ts, "payload": payload})


def message(role, text, ts="2026-01-01T10:00:00Z"):
    return said("response_item", {"type": "message", "role": role, "content": text}, ts)


def test_pointers_are_not_made_again_for_their_roots(spark):
    nodes = spark.createDataFrame([("a", None, None, False), ("b", "a", None, True), ("c", "b", None, True), ("d", "gone", "a", True)], "id string, parent_id string, root_hint string, is_subagent boolean")
    roots = resolve_roots(next_pointers(nodes))
    assert "Join" not in plan(roots)
    assert {r.id: r.root_id for r in roots.collect()} == {"a": "a", "b": "a", "c": "a", "d": "a"}


def test_postings_of_a_segment_take_one_shuffle(spark):
    doc = ("k", "claude", None, "/p", "id", "one two", None)
    docs = spark.createDataFrame([doc], "session_key string, source string, archive_name string, project_path string, session_id string, first_prompt string, agent_title string")
    rows = [("k", "claude", None, 0, "Two three 修复 three"), ("k", "claude", None, 0, "three Four"), ("k", "claude", None, 1, "four 修"), ("j", "pi", "old", 0, None), ("j", "pi", "old", 0, "four")]
    texts = spark.createDataFrame(rows, "session_key string, source string, archive_name string, code int, text string")
    made = G._postings(docs, texts).sortWithinPartitions(*G.SCOPE, *G.TABLE_ORDER["postings"])
    got = sorted((r.source, r.archive_name or "", r.session_key, r.code, r.token) for r in made.collect())
    words = ["p", "id", "one", "two", "three", "four", "修", "复", "修复"]
    assert got == sorted([("claude", "", "k", 0, w) for w in words] + [("claude", "", "k", 1, w) for w in ("four", "修")] + [("pi", "old", "j", 0, "four")])
    text = plan(made)
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1


def test_entries_are_the_texts_and_the_facts_of_one_parse(as_lines):
    lines = as_lines(
        {
            "s": [
                said("session_meta", {"id": "s"}),
                message("user", " <env>", "2026-01-01T10:00:00Z"),
                message("user", [{"text": "fi"}, {"text": "rst"}], "2026-01-01T12:00:00+02:00"),
                said("event_msg", {"type": "message", "role": "user", "content": "no item"}),
                said("event_msg", {"type": "agent_reasoning", "text": "why"}),
                message("assistant", "answer", "2026-01-01T11:00:00Z"),
                message("user", "second", None),
                said("response_item", {"type": "function_call", "arguments": '{"command":"ls"}'}),
                said("response_item", {"type": "function_call", "arguments": "no json"}),
                said("response_item", {"type": "function_call_output", "output": {"a": 1}}),
                said("response_item", {"type": "agent_message"}, "2026-01-01T12:30:00Z"),
            ],
            "u": [r'{"type":"respons\u0065_item","payload":{"type":"message","role":"user","content":"escaped"}}', "{"],
            "none": [said("turn_context", {"model": "m"})],
        }
    )
    made = B.entries(lines)
    assert plan(made).count("parseJson") == 2  # the line, and the arguments of a call
    want = [("s", 2, "content", "first"), ("s", 4, "reasoning", "why"), ("s", 5, "content", "answer"), ("s", 6, "content", "second"), ("s", 7, "tool", "ls"), ("s", 9, "tool", '{"a":1}'), ("u", 0, "content", "escaped")]
    assert sorted((r.session_id, r.unit, r.kind, r.text) for r in made.where("text is not null").collect()) == want
    assert sorted((r.session_id, r.unit, r.kind, r.text) for r in B.texts(lines).collect()) == want
    facts = {r.session_id: (r.first_prompt, r.updated_at) for r in B.session_facts(made).collect()}
    assert facts == {"s": ("first", "2026-01-01 12:30:00"), "u": ("escaped", None)}


def test_lines_are_not_shuffled_if_most_files_are_named(spark, monkeypatch):
    lines = fixture_b.lines(spark, SMALL)
    tree = B.threads(B.identities(lines)).where("cast(thread_id as int) < 60")
    plans = []
    entries = B.entries
    monkeypatch.setattr(B, "entries", lambda rows, counts=None: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), entries(rows, counts))[1])
    roots = sorted(r.root_id for r in tree.select("root_id").distinct().collect())

    def parsed(named):
        keys = spark.createDataFrame([("codex", r) for r in named], "source string, session_id string")
        got = D.group_parser(lines, tree)(keys)
        return sorted(map(tuple, got.docs.collect()), key=str), sorted(map(tuple, got.texts.collect()), key=str)

    docs, texts = parsed(roots)
    some_docs, some_texts = parsed(roots[:1])
    assert "Join" not in plans[0] and "Join" in plans[1]
    assert len(docs) == len(roots) and some_docs == [d for d in docs if d[2] == roots[0]] and some_texts == [t for t in texts if t[0] == f"codex:{roots[0]}"]


def test_envelope_lines_are_the_json_of_their_objects(spark):
    rows = fixture_b.lines(spark, SMALL).where(F.col("session_id").rlike(r"^rollout-\d$")).collect()
    assert len(rows) > 100
    for r in rows:
        assert json.dumps(json.loads(r.line), separators=(",", ":"), ensure_ascii=False) == r.line
