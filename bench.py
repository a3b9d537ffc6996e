"""Benchmark: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR, one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skeinlog.session import build_session  # noqa: E402
from workload import area_b, fixture_a, fixture_b, fixture_cd, fixture_x  # noqa: E402
from workload.registry import queries  # noqa: E402

HEADLINE = [
    "usage_by_source",
    "session_summaries",
    "message_records",
    "tool_call_pairs",
    "parallel_batches",
    "page_tail",
    "session_search_messages",
    "envelope_records",
    "subagent_token_delta",
    "thread_roots",
    "subagent_spawn_links",
    "relational_records",
    "step_usage_rollup",
    "tree_entry_records",
    "tree_model_contexts",
    "usage_summary",
    "cost_by_model",
    "dashboard_projects",
    "session_texts",
    "search_tokens",
    "search_fused",
    "search_deep",
    "line_byte_offsets",
    "manifest_diff",
    "memory_inventory",
    "export_markdown",
    "stream_daily_usage",
    "stream_deduplicated_lines",
    "stream_merged_turns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    # start the Python workers and the code generator once, outside of the timings
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    # the line and store tables the queries read stand for existing transcript stores; their build is timed apart
    start = time.perf_counter()
    for build in (fixture_a.lines, fixture_b.lines, fixture_cd.c_sessions, fixture_cd.c_messages, fixture_cd.c_parts, fixture_cd.d_lines):
        build(spark, sf_dir)
    times["store_build"] = round(time.perf_counter() - start, 3)
    # and so are the search index and the thread forest, which queries read
    for label, build in (("index_build", fixture_x.index), ("forest_build", area_b.forest)):
        start = time.perf_counter()
        build(spark, sf_dir)
        times[label] = round(time.perf_counter() - start, 3)
    for name in wanted:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
