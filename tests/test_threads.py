import json

from skeinlog.operators.tree import next_pointers, resolve_roots
from skeinlog.sources import dialect_b as B
from skeinlog.sources import dialect_c as C


def roots(spark, rows):
    nodes = spark.createDataFrame(rows, "id string, parent_id string, root_hint string, is_subagent boolean")
    return {r.id: r.root_id for r in resolve_roots(next_pointers(nodes)).collect()}


def test_hints_parents_orphans_and_cycles(spark):
    got = roots(
        spark,
        [
            ("r", None, "r", False),
            ("a", "r", None, True),
            ("b", "a", None, True),
            ("h", "b", "r", True),
            ("badhint", "a", "b", True),
            ("gone", "missing", None, True),
            ("below", "gone", None, True),
            ("x", "y", None, True),
            ("y", "x", None, True),
            ("z", "y", None, True),
            ("self", "self", None, True),
        ],
    )
    assert got == {"r": "r", "a": "r", "b": "r", "h": "r", "badhint": "r", "gone": "gone", "below": "gone", "x": "x", "y": "y", "z": "z", "self": "self"}


def test_long_chain_and_hot_parent(spark):
    chain = [("n0", None, None, False)] + [(f"n{i}", f"n{i - 1}", None, True) for i in range(1, 70)]
    star = [(f"k{i}", "n0", None, True) for i in range(300)]
    got = roots(spark, chain + star)
    assert set(got.values()) == {"n0"} and len(got) == 370


def test_relational_chains_are_followed_to_their_end(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None) for i in range(25)] + [("o", "nowhere"), ("below", "o"), ("p", "q"), ("q", "p")]
    got = {r.session_id: r.root_id for r in C.roots(spark.createDataFrame(rows, "id string, parent_id string")).collect()}
    assert {got[f"s{i}"] for i in range(25)} == {"s0"}
    assert got["o"] == "nowhere" and got["below"] == "nowhere" and got["p"] == "p" and got["q"] == "q"


def env(envelope, **payload):
    return json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": envelope, "payload": payload})


def count(i, o, h, t):
    return env("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": i, "output_tokens": o, "cached_input_tokens": h, "total_tokens": t}})


def test_child_usage_is_the_growth_since_its_assignment(as_lines):
    meta = {"id": "child", "parent_thread_id": "root", "agent_path": "/root/job"}
    lines = as_lines(
        {
            "f": [
                env("session_meta", **meta),
                count(100, 20, 10, 120),
                count(110, 25, 12, 135),
                env("response_item", type="agent_message", recipient="/root/other"),
                env("response_item", type="agent_message", recipient="/root/job"),
                env("response_item", type="agent_message", recipient="/root/job"),
                count(150, 35, 20, 185),
            ]
        },
        1,
    )
    row = B.own_usage(lines, B.identities(lines)).first()
    assert (row.input_tokens, row.output_tokens, row.cache_tokens, row.total_tokens) == (40, 10, 8, 50)


def test_missing_recipient_matches_missing_path_and_reset_counts_whole(as_lines):
    lines = as_lines(
        {
            "a": [env("session_meta", id="a", parent_thread_id="r"), count(10, 0, 0, 10), env("response_item", type="agent_message"), count(30, 0, 0, 30)],
            "b": [env("session_meta", id="b", parent_thread_id="r"), count(50, 0, 0, 50), env("response_item", type="agent_message"), count(7, 0, 0, 7)],
            "c": [env("session_meta", id="c"), count(10, 0, 0, 10), env("response_item", type="agent_message"), count(30, 0, 0, 30)],
        }
    )
    got = {r.thread_id: r.total_tokens for r in B.own_usage(lines, B.identities(lines)).collect()}
    assert got == {"a": 20, "b": 7, "c": 30}


def test_first_header_names_the_file_and_forks_are_no_subagents(as_lines):
    lines = as_lines(
        {
            "f": ["not json", env("session_meta", id=" t1 ", forked_from_id="old"), env("session_meta", id="t2")],
            "g": [env("session_meta", session_id="only")],
            "h": [env("session_meta", id="k", session_id="root", forked_from_id="par")],
            "n": [env("session_meta", cwd="/x")],
        }
    )
    got = {r.session_id: (r.thread_id, r.is_subagent, r.parent_id) for r in B.identities(lines).collect()}
    assert got == {"f": ("t1", False, None), "g": ("only", False, None), "h": ("k", True, "par")}


def test_links_by_event_by_output_and_by_path(as_lines):
    lines = as_lines(
        {
            "root": [
                env("session_meta", id="root"),
                env("response_item", type="function_call_output", call_id="s2", output='{"agent_id":"too-early"}'),
                env("response_item", type="function_call", name="spawn_agent", call_id="s1", arguments='{"task_name":"one"}'),
                env("response_item", type="function_call", name="spawn_agent", call_id="s2", arguments='{"task_name":"two"}'),
                env("response_item", type="function_call", name="spawn_agent", call_id="s3", arguments='{"task_name":"deep/three"}'),
                env("event_msg", type="sub_agent_activity", kind="started", agent_thread_id="c1", event_id="s1"),
                env("response_item", type="function_call_output", call_id="s2", output='{"agent_id":"c2"}'),
            ],
            "c1": [env("session_meta", id="c1", parent_thread_id="root")],
            "c2": [env("session_meta", id="c2", parent_thread_id="root")],
            "c3": [env("session_meta", id="c3", parent_thread_id="root", agent_path="/root/deep/three")],
            "c4": [env("session_meta", id="c4", parent_thread_id="root", agent_path="/root/nothing")],
        },
        1,
    )
    tree = B.threads(B.identities(lines))
    got = {r.thread_id: r.call_id for r in B.subagent_links(lines, tree).collect()}
    assert got == {"c1": "s1", "c2": "s2", "c3": "s3", "c4": None}


def test_answers_are_keyed_by_question_text(as_lines):
    ask = json.dumps({"questions": [{"id": "q", "question": "Go?"}]})
    lines = as_lines(
        {
            "f": [
                env("response_item", type="function_call", name="request_user_input", call_id="a", arguments=ask),
                env("response_item", type="function_call_output", call_id="a", output='{"answers":{"q":{"answers":["Yes"]}}}'),
                env("response_item", type="function_call_output", call_id="b", output="plain"),
            ]
        },
        1,
    )
    rows = B.records(lines).orderBy("unit").collect()
    assert [(r.record_type, r.tool_name, r.content, r.result_meta) for r in rows] == [
        ("assistant", "ask_user_question", "", None),
        ("tool_result", None, "", '{"answers":{"Go?":["Yes"]}}'),
        ("tool_result", None, "plain", None),
    ]
