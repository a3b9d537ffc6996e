import json

from pyspark.sql import functions as F

from skeinlog.operators import models
from skeinlog.operators import timeline as T
from skeinlog.sources import dialect_c as C
from skeinlog.sources import dialect_d as D


def test_call_and_result_of_a_tool_part(spark):
    messages = spark.createDataFrame([("m2", "s", '{"role":"assistant"}', 5), ("m1", "s", '{"role":"user"}', 5)], "id string, session_id string, data string, time_created bigint")
    part = {"type": "tool", "tool": "bash", "callID": "c", "state": {"status": "completed", "input": {"command": "ls", "filePath": "/x"}, "output": {"a": 1}}}
    parts = spark.createDataFrame([("p1", "m2", "s", json.dumps(part), 5), ("p0", "m1", "s", '{"type":"text","text":"hi"}', 5)], "id string, message_id string, session_id string, data string, time_created bigint")
    rows = C.records(messages, parts).orderBy("unit", "seq").collect()
    assert [((r.unit, r.seq), r.record_type, r.content, r.tool_input) for r in rows] == [
        ((0, 0), "user", "hi", None),
        ((1, 0), "assistant", "", '{"command":"ls","file_path":"/x"}'),
        ((1, 1), "tool_result", '{"a":1}', None),
    ]


def test_nine_messages_make_three_pages_of_three(spark):
    messages = spark.createDataFrame([(f"m{i}", "s", '{"role":"user"}', i // 2) for i in range(9)], "id string, session_id string, data string, time_created bigint")
    parts = spark.createDataFrame([(f"p{i}", f"m{i}", "s", json.dumps({"type": "text", "text": str(i)}), i) for i in range(9)], "id string, message_id string, session_id string, data string, time_created bigint")
    records = C.records(messages, parts).cache()
    cursors = [None, 6, 3]
    pages = [[r.content for r in T.backward_page(records, 3, c).orderBy("unit").collect()] for c in cursors]
    assert pages == [["6", "7", "8"], ["3", "4", "5"], ["0", "1", "2"]]


def entry(kind, **fields):
    return json.dumps({"type": kind, **fields})


def message(eid, role, **fields):
    return entry("message", id=eid, timestamp="2026-01-01T00:00:00Z", message={"role": role, **fields})


def session_file():
    calls = [{"type": "toolCall", "id": f"t{i}", "name": "bash", "arguments": {"command": "x"}} for i in (1, 2)]
    blocks = [{"type": "thinking", "thinking": "why"}, {"type": "text", "text": "done"}, *calls]
    use = {"input": 10, "output": 5, "cacheRead": 3, "cacheWrite": 2, "totalTokens": 20}
    return [
        entry("session", id="sid", timestamp="2026-01-01T00:00:00Z", cwd="/w"),
        entry("thinking_level_change", id="l", thinkingLevel="high"),
        message("u", "user", content="hello"),
        message("a", "assistant", provider="p", model="m", content=blocks, usage=use),
        message("r", "toolResult", toolCallId="t1", toolName="bash", content=[{"type": "image", "mimeType": "image/png"}], usage={"input": 99}),
        entry("session_info", name=" Named "),
    ]


def test_session_header_usage_and_title(as_lines):
    lines = as_lines({"f": session_file(), "nohead": session_file()[1:], "lateheader": ["oops", *session_file()]}, 1)
    rows = {r.session_id: r for r in D.sessions(lines).collect()}
    assert set(rows) == {"f", "lateheader"}
    row = rows["f"]
    assert (row.agent_title, row.first_prompt, row.project_path) == ("Named", "hello", "/w")
    assert (row.input_tokens, row.output_tokens, row.cache_tokens, row.total_tokens) == (10, 5, 5, 20)
    contexts = models.context_arrays(D.model_turns(lines)).where("session_id = 'f'").select(models.context_text(F.col("model_contexts")).alias("c")).first()
    assert contexts.c == "p/m/high"


def test_blocks_keep_their_order(as_lines):
    rows = D.records(as_lines({"f": session_file()}, 1), "tool").orderBy("unit", "seq").collect()
    assert [(r.record_type, r.content, r.tool_use_id) for r in rows] == [
        ("user", "hello", None),
        ("thinking", "why", None),
        ("assistant", "done", None),
        ("assistant", "", "t1"),
        ("assistant", "", "t2"),
        ("tool_result", "[image: image/png]", "t1"),
    ]
    texts = D.texts(as_lines({"f": session_file()}, 1)).where("kind = 'tool'").orderBy("unit", "seq").collect()
    assert [r.text for r in texts] == ['bash {"command":"x"}', 'bash {"command":"x"}', "bash [image: image/png]"]


def test_both_branches_stay_in_file_order_and_bash_is_paired(as_lines):
    lines = as_lines({"f": [entry("session", id="s"), message("a", "user", content="one"), message("b", "user", content="two"), message("x", "bashExecution", command="ls", output="o", exitCode=1)]}, 1)
    rows = D.records(lines, "tool").orderBy("unit", "seq").collect()
    assert [(r.content, r.tool_use_id) for r in rows] == [("one", None), ("two", None), ("", "pi-bash-x"), ("o", "pi-bash-x")]


def test_files_without_a_header_give_no_records_and_no_hits(as_lines):
    lines = as_lines({"f": session_file(), "nohead": session_file()[1:]}, 1)
    assert {r.session_id for r in D.records(lines).collect()} == {"f"}
    assert {r.session_id for r in D.search_hits(lines, "hello").collect()} == {"f"}
