"""Registered queries on tables that the small copies do not show: late sessions, long first lines, sizes over a gigabyte."""

import pytest
from pyspark.sql import functions as F

from skeinlog.functions import text as X
from skeinlog.operators import ordered
from skeinlog.plans import index
from skeinlog.sources import configs, dialect_b
from workload import area_corpus, fixture_a, fixture_b, fixture_cd, fixture_h, fixture_i
from workload.compare import compare
from workload.registry import oracles, queries
from workload.tables import exists

QUERIES, ORACLES = queries(), oracles()


def differences(spark, con, name, sf_dir):
    return compare(spark, con, name, QUERIES[name], ORACLES[name], sf_dir)


def written(rows, name, tmp_path):
    rows.write.parquet(f"{tmp_path}/{name}.parquet")


def connected(tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


def test_a_workflow_is_found_by_a_word_behind_the_shown_description(spark, tmp_path):
    long = "x" * 161
    rows = [(4, f"# Head\n{long}9"), (64, f"{long}\n9"), (124, "a 9"), (304, "no line")]
    written(spark.createDataFrame(rows, "doc_id bigint, text string"), "documents", tmp_path)
    got = {r.name for r in QUERIES["workflow_filter"](spark, str(tmp_path)).collect()}
    assert got == {"x4", "x124"}
    _, problems = differences(spark, connected(tmp_path, "documents"), "workflow_filter", str(tmp_path))
    assert not problems, problems


def test_sizes_over_a_gigabyte_are_shown_as_such(spark, monkeypatch):
    import duckdb

    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(1_500_000)).alias("text"))
    monkeypatch.setattr(area_corpus, "table", lambda *_: docs)
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT range AS doc_id, repeat('x', 1500000) AS text FROM range(1200)")
    rows, problems = differences(spark, con, "storage_stats", "unused")
    assert rows == 4 and not problems, problems


def test_ties_of_the_shown_decimal_go_to_the_even_digit(spark):
    sizes = [1023, 1280, 1792, 1024 * 1024 + 256 * 1024, 5 * 2**28]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(X.human_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["1023 B", "1.2 KB", "1.8 KB", "1.2 MB", "1.2 GB"]


def test_open_texts_of_late_sessions_are_given_out(spark, tmp_path):
    small = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    written(small.withColumn("conv_id", F.col("conv_id") + 60_000), "conversations", tmp_path)
    _, problems = differences(spark, connected(tmp_path, "conversations"), "stream_turns_of_quiet_sessions", str(tmp_path))
    assert not problems, problems


def test_bounds_of_a_long_session_do_not_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICES", 100, raising=False)
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "few").otherwise("hot").alias("k"), F.expr("id * 7919 % 20011").alias("t"), F.lit("x").alias("o"))
    cut = ordered.equal_depth_chunk(rows.where("k = 'hot' OR t < 3"), ["k"], "t", 10).collect()
    slices = sorted((r.t, r.chunk) for r in cut if r.k == "hot")
    assert all(x[1] <= y[1] for x, y in zip(slices, slices[1:], strict=False))
    assert 90 <= len({c for _, c in slices}) <= 100
    depth = [sum(c == s for _, c in slices) for s in {c for _, c in slices}]
    assert max(depth) < 5 * len(slices) / 100
    assert len(cut) == rows.where("k = 'hot' OR t < 3").count() and {r.chunk for r in cut if r.k == "few"} == {0}


def test_sections_of_config_files_need_no_shuffle(spark):
    content = "a = 1 # [x]\r\n[ s1 ]\nb=2\n\n[s2] # note\n[]\nc = \"[x]\"\nd\n['s 3']\ne = 5\n[s4]"
    files = spark.createDataFrame([("/f", "g", content), ("/f", "other", "x = 1"), ("/none", "g", None), ("/empty", "g", "")], "path string, scope string, content string")
    rows = configs._toml_lines(files)
    got = sorted((r.path, r.scope, r.line_no, r.section, r.key, r.value) for r in rows.collect())
    assert got == [("/f", "g", 0, "", "a", "1"), ("/f", "g", 2, "s1", "b", "2"), ("/f", "g", 6, "", "c", '"[x]"'), ("/f", "g", 9, "'s 3'", "e", "5"), ("/f", "other", 0, "", "x", "1")]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_files_are_written_by_many_tasks(spark):
    from workload.area_files import spread

    rows = spark.range(200).select(F.col("id").cast("string").alias("home"), F.lit("n").alias("name"))
    tasks = spread(rows, "home", "name").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("build", [fixture_a.lines, fixture_b.lines, fixture_cd.c_messages, fixture_cd.c_parts, fixture_cd.d_lines, fixture_h.lines])
def test_lines_made_of_one_row_group_are_in_many_files(spark, build):
    """One row group is one task, and the lines it makes would be one row group again."""
    files = build(spark, "/root/testdata/sf0.001").select("_metadata.file_path").distinct().count()
    assert files == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_records_folded_per_file_are_the_child_timeline(spark):
    sf = "/root/testdata/sf0.001"
    lines = fixture_b.lines(spark, sf)
    recs, tree = dialect_b.records(lines), dialect_b.threads(dialect_b.identities(lines))
    plain = dialect_b.child_timeline(recs, tree).groupBy("session_id", "root_id", "thread_id").agg(F.count("*").alias("n"))
    folded = dialect_b.child_timeline(recs, tree, F.count("*").alias("n")).select(*plain.columns)
    rows = sorted(folded.collect())
    assert rows == sorted(plain.collect()) and len(rows) > 300


def test_postings_are_shuffled_once_and_distinct(spark):
    docs = spark.createDataFrame([("k", "id", "/p", "one two", None)], "session_key string, session_id string, project_path string, first_prompt string, agent_title string")
    texts = spark.createDataFrame([("k", 0, "Two three 修复 three"), ("k", 0, "three Four"), ("k", 1, "four 修"), ("j", 0, None)], "session_key string, code int, text string")
    rows = index.index_tokens(docs, texts).sortWithinPartitions("token", "session_key")
    content = ["id", "p", "one", "two", "three", "four", "修", "复", "修复"]
    assert sorted(map(tuple, rows.collect())) == sorted([(t, 0, "k") for t in content] + [("four", 1, "k"), ("修", 1, "k")])
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "HashAggregate" not in plan


def test_texts_are_stored_without_postings(spark, tmp_path):
    from workload import fixture_x

    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90)
    written(small, "documents", tmp_path)
    assert QUERIES["session_texts"](spark, str(tmp_path)).count() > 90
    path = fixture_x._built[spark.sparkContext.applicationId, str(tmp_path)]
    assert not exists(spark, f"{path}/postings")
    assert fixture_x.index(spark, str(tmp_path)).postings.count() > 90 and fixture_x._built[spark.sparkContext.applicationId, str(tmp_path)] == path


def test_a_source_is_searched_before_the_others_are_indexed(spark, tmp_path):
    for name in ("conversations", "events"):
        written(spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("event_id < 60" if name == "events" else "true"), name, tmp_path)
    sf = str(tmp_path)
    alone = sorted(QUERIES["search_deep_all_sources"](spark, sf).collect())
    store = fixture_i.all_index(spark, sf, ["pi"])
    assert {r.source for r in store.versions().select("source").distinct().collect()} == {"pi"}
    every = fixture_i.all_index(spark, sf)
    assert every.path == store.path and {r.source for r in every.versions().select("source").distinct().collect()} == set(fixture_i.SOURCES)
    assert alone and sorted(QUERIES["search_deep_all_sources"](spark, sf).collect()) == alone
    # two segments hold what one over all sources does
    docs = lambda s: sorted((r.session_key, r.modified) for r in s.live("docs").collect())
    assert docs(every) == docs(fixture_i.all_sources(spark, sf))


def test_documents_are_written_by_all_shuffle_partitions(spark, monkeypatch):
    from workload import area_files

    asked = []
    plain = area_files.export.write_documents
    monkeypatch.setattr(area_files.export, "write_documents", lambda rows, path, n: (asked.append(n), plain(rows, path, n)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert area_files._documents(spark, "/root/testdata/sf0.001", "json").where("not endswith(document, ']}\n')").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert asked == [23]


def test_small_files_are_read_once_and_listed_many_to_a_task(spark, tmp_path):
    """A file of one split needs no totals of earlier splits; a larger one beside it still does."""
    from skeinlog.session import tune
    from skeinlog.sources import files

    tune(spark)
    for i in range(70):
        (tmp_path / "t" / f"d{i}").mkdir(parents=True)
        (tmp_path / "t" / f"d{i}" / "s.jsonl").write_text(f"é{i}\n\nlast")
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = files.scan_lines(spark, str(tmp_path / "t"))
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in sc.statusTracker().getJobIdsForGroup("listing") for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert tasks and max(tasks) <= 64
        got = sorted((r.off, r.chunk, r.line) for r in rows.collect())
        assert got == sorted(x for i in range(70) for x in ((0, 0, f"é{i}"), (len(f"é{i}".encode()) + 1, 0, ""), (len(f"é{i}".encode()) + 2, 0, "last")))
        leaves = rows._jdf.queryExecution().executedPlan().collectLeaves()
        assert sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())) == 210
        # 4,000 bytes a split: the larger file is cut, the small ones stay whole
        (tmp_path / "t" / "d0" / "s.jsonl").write_text("".join(f"{i:06d}\n" for i in range(2000)))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        rows = files.scan_lines(spark, str(tmp_path / "t"))
        cut = [(r.off, r.line) for r in rows.where("file_size > 4000").orderBy("off").collect()]
        assert cut == [(7 * i, f"{i:06d}") for i in range(2000)] and rows.where("file_size > 4000").select("chunk").distinct().count() > 2
        assert rows.where("file_size <= 4000").count() == 69 * 3
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
