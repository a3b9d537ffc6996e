import json
import os
from urllib.parse import urlparse

from pyspark.sql import functions as F

from skeinlog.plans import incremental, pricing, scope
from skeinlog.session import scratch_path
from skeinlog.sources import dialect_a as A
from skeinlog.sources import export, files
from skeinlog.streaming import sinks
from workload import fixture_a
from workload.registry import queries

SMALL = "/root/testdata/sf0.001"


def test_offsets_over_many_splits(spark, tmp_path):
    body = "".join(f"ligne é {i} {'漢' * (i % 7)}\r\n" if i % 3 else f"{i}\n" for i in range(3000)) + "last without newline"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s1.jsonl").write_bytes(body.encode())
    (tmp_path / "p" / "s2.jsonl").write_bytes(b"\n\nx\n")
    (tmp_path / "p" / "note.txt").write_bytes(b"ignored\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = files.session_lines(files.scan_lines(spark, str(tmp_path)))
        assert lines.select("chunk").distinct().count() > 3
        got = {(r.session_id, r.off): r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {}
    for name, data in (("s1", body.encode()), ("s2", b"\n\nx\n")):
        off = 0
        for piece in data.split(b"\n")[: -1 if data.endswith(b"\n") else None]:
            want[(name, off)] = piece.decode()
            off += len(piece) + 1
    assert got == want


def test_an_archived_copy_is_a_session_of_its_own(spark, tmp_path):
    line = json.dumps({"type": "assistant", "message": {"role": "assistant", "content": "x", "usage": {"input_tokens": 10}}})
    for home in ("p", "archives/snap/p"):
        (tmp_path / home).mkdir(parents=True)
        (tmp_path / home / "s.jsonl").write_text(line + "\n")
    scanned = files.scan_lines(spark, str(tmp_path))
    assert {(r.session_id, r.input_tokens) for r in A.sessions(files.session_lines(scanned)).collect()} == {("s", 10), ("snap/s", 10)}
    assert {r.session_id for r in files.session_lines(scanned, "box").collect()} == {"@wsl:box/s", "@wsl:box/snap/s"}


def test_a_compacted_log_reads_on_with_newer_batches(spark, tmp_path):
    write = sinks.append_log(str(tmp_path / "log"))
    for batch, rows in enumerate([[("a", 1), ("b", 1)], [("a", 2)]]):
        write(spark.createDataFrame(rows, "k string, n int"), batch)
    sinks.compact(spark, str(tmp_path / "log"), ["k"], str(tmp_path / "base"))
    newer = spark.createDataFrame([("b", 3, 2)], "k string, n int, batch int")
    rows = sinks.latest(spark.read.parquet(str(tmp_path / "base")).unionByName(newer), ["k"]).collect()
    assert {(r.k, r.n) for r in rows} == {("a", 2), ("b", 3)}


def test_equal_files_do_not_cancel_in_the_fingerprint(spark):
    one = spark.createDataFrame([("/a", 1, 5)], "path string, size int, mtime int")
    assert incremental.fingerprint(one.union(one)).first().paths != 0


def test_export_is_written_in_order(spark):
    lines = fixture_a.lines(spark, SMALL)
    rows = export.export_rows(A.sessions(lines), A.records(lines, "tool"), "md", "claude").cache()
    path = scratch_path(spark, "export")
    export.write_export(rows, path, 3)
    names = sorted(r.p for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("p")).distinct().collect())
    written = []
    for n in names:
        with open(urlparse(n).path) as f:
            written += [line for line in f.read().splitlines()]
    assert len(written) == rows.count()
    got = [(r.session_id, r.unit) for r in spark.createDataFrame([(w,) for w in written], "v string").select(F.from_json("v", "session_id string, unit bigint").alias("j")).select("j.*").collect()]
    assert got == sorted(got)
    call = rows.where("startswith(text, '### 🔧 Bash')").first().text
    assert call.startswith("### 🔧 Bash\n\n```json\n{") and call.endswith("}\n```\n")


def test_merge_drops_vanished_keys(spark):
    schema = "source string, key string, version string"
    prev = spark.createDataFrame([("c", "a", "1"), ("c", "b", "1"), ("c", "gone", "1")], schema)
    now = spark.createDataFrame([("c", "a", "1"), ("c", "b", "2"), ("c", "new", "1")], schema)
    diff = incremental.manifest_diff(prev, now)
    assert {r.key: r.status for r in diff.collect()} == {"a": "unchanged", "b": "changed", "gone": "deleted", "new": "new"}
    parsed = incremental.stale_keys(diff).withColumn("version", F.lit("p"))
    got = {r.key: r.version for r in incremental.merge(prev, parsed, now).collect()}
    assert got == {"a": "1", "b": "p", "new": "p"}


def test_price_match_rules(spark):
    prices = pricing.price_table(spark, [("gpt-5", 1.0, 1.0), ("gpt-5.4", 2.0, 2.0), ("other/gpt-5.4-mini", 9.0, 9.0), ("openai/gpt-5.4-mini", 3.0, 3.0), (" ", 7.0, 7.0), ("gpt-5.4", 8.0, 8.0)])
    models = spark.createDataFrame([(m,) for m in ("gpt-5.4-nano", "openai/gpt-5.4-mini", "gpt-5.4-mini", "gpt-4", "acme/gpt-5", "other/GPT-5.4-mini-x")], "model string")
    got = {r.model: r.input for r in pricing.match_prices(models, prices).collect()}
    assert got == {"gpt-5.4-nano": 2.0, "openai/gpt-5.4-mini": 3.0, "gpt-5.4-mini": 3.0, "acme/gpt-5": 1.0, "other/GPT-5.4-mini-x": 9.0}


def test_source_choice():
    assert scope.resolve_source(["pi"], None) == "pi"
    assert scope.resolve_source([], None) == "claude"
    assert scope.resolve_source(["pi"], "codex") == "codex"


def test_stream_and_batch_merge_agree(spark):
    batch = A.records(fixture_a.lines(spark, SMALL), "tool").where("record_type = 'assistant'")
    want = sorted((r.session_id, r.unit, "call" if r.tool_name else "text", r.content, r.tool_use_id or "") for r in batch.collect())
    got = sorted((r.session_id, r.unit, r.kind, r.content, r.tool_use_id or "") for r in queries()["stream_merged_turns"](spark, SMALL).collect())
    assert got == want


def test_repository_stays_small():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    total = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs)
    assert total < 30 * 1024 * 1024
