"""Plan shapes and skew: what must hold when one session has a third of all rows."""

import json

from pyspark.sql import functions as F

from skeinlog.operators.ordered import RunningSum, ordered_scan, with_chunk
from skeinlog.plans import index as I
from skeinlog.plans import pricing, search
from skeinlog.sources import dialect_a as A
from skeinlog.sources import dialect_b as B
from workload import fixture_a, fixture_s, fixture_x

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_session_is_scanned_by_many_tasks(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("pos"))
        scanned = ordered_scan(with_chunk(rows, "pos", 1000), ["k"], ["pos"], [RunningSum("n", F.lit(1).cast("bigint"))])
        spread = scanned.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
        assert len(spread) >= 4 and max(r.n for r in spread) < 13_334 * 0.6
        assert scanned.where("k = 'hot'").agg(F.max("n")).first()[0] == 13_334
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_no_nested_loop_or_cross_join(spark):
    prices = pricing.price_table(spark)
    for df in (
        pricing.cost_by_model(fixture_s.sessions(spark, SMALL), prices),
        A.records(fixture_a.lines(spark, SMALL)),
        search.search(fixture_x.index(spark, SMALL), "the"),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_every_line_is_parsed_once_per_branch(spark):
    text = A.parsed(fixture_a.lines(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("parseJson") == 1


def test_query_tokens_reach_the_scan(spark):
    index = fixture_x.index(spark, SMALL)
    text = plan(search.token_scores(index, index.docs, ["the", "and"], [0]))
    assert "In(token" in text and "ReadSchema: struct<token:string,code:int,session_key:string>" in text


def test_one_open_island_over_many_chunks(as_lines):
    """A session that never closes its text: pieces are joined per chunk first, and the result stays whole."""
    line = [json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": f"{i} "}]}}) for i in range(500)]
    rows = A.records(as_lines({"hot": line}, 7)).collect()
    assert [(r.unit, r.content) for r in rows] == [(499, "".join(f"{i} " for i in range(500)))]


def test_rows_without_a_call_id_do_not_meet_in_one_partition(as_lines):
    lines = as_lines({"hot": [json.dumps({"type": "response_item", "payload": {"type": "function_call_output", "output": str(i)}}) for i in range(200)]}, 10)
    records = B.records(lines)
    assert records.count() == 200
    assert sorted(int(r.content) for r in records.collect()) == list(range(200))


def test_group_texts_put_the_root_first(spark, as_lines):
    def meta(**p):
        return json.dumps({"timestamp": "2026-01-01T00:00:00Z", "type": "session_meta", "payload": p})

    def said(text):
        return json.dumps({"type": "response_item", "payload": {"type": "message", "role": "user", "content": text}})

    lines = as_lines(
        {
            "z-root": [meta(id="r", timestamp="2026-01-01T09:00:00Z"), said("root text")],
            "late": [meta(id="a", parent_thread_id="r", timestamp="2026-01-01T08:00:00Z"), said("late")],
            "early": [meta(id="b", parent_thread_id="a", timestamp="2026-01-01T07:00:00Z"), said("early")],
        }
    )
    kept = I.session_texts(B.group_texts(B.texts(lines), B.threads(B.identities(lines))), ("member", "unit", "seq"))
    assert [(r.session_key, r.text) for r in kept.orderBy("member", "unit").collect()] == [("r", "root text"), ("r", "early"), ("r", "late")]


def test_price_catalog_file(spark, tmp_path):
    body = {"data": [{"id": "v/m-1", "canonical_slug": None, "pricing": {"prompt": "0.000002", "completion": 0.00001}}, {"id": "v/m-2:batch", "pricing": {"prompt": "1"}}]}
    (tmp_path / "catalog.json").write_text(json.dumps(body))
    catalog = pricing.read_catalog(spark, str(tmp_path / "catalog.json"))
    models = spark.createDataFrame([("M.1",), ("m-2",)], "model string").withColumn("model", F.replace("model", F.lit("M.1"), F.lit("other/M-1")))
    got = {r.model: (r.input, r.output, r.matched_model) for r in pricing.refresh_report(models, catalog).collect()}
    assert got["other/M-1"] == (2.0, 10.0, "v/m-1") and got["m-2"] == (None, None, None)
