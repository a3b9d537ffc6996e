"""One session that holds most rows: pieces of a text, pages and positions must spread over many tasks."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlog.operators import timeline as T
from skeinlog.operators.ordered import CHUNK_ROWS, SumSince, Total, ordered_scan
from skeinlog.sources import dialect_a as A
from skeinlog.sources import dialect_c as C


def test_sums_since_an_event_and_totals_equal_a_plain_loop(spark):
    rng = random.Random(7)
    rows = [(k, i // 4, i, rng.randrange(9), rng.random() < p) for k, n, p in (("a", 90, 0.1), ("b", 41, 0.5), ("c", 33, 0.0), ("d", 1, 1.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, chunk bigint, pos int, v bigint, e boolean")
    got = {(r.k, r.pos): (r.since, r.n) for r in ordered_scan(df, ["k"], ["pos"], [SumSince("since", F.col("v"), F.col("e")), Total("n", F.lit(1).cast("bigint"))]).collect()}
    want = {}
    for key in "abcd":
        own, since = [r for r in rows if r[0] == key], 0
        for _, _, pos, v, event in own:
            want[key, pos] = (since, len(own))
            since = 0 if event else since + v
            # the event's own row counts neither for itself nor for the rows after it
    assert got == want


def split_messages(rng, n):
    """Messages cut at random into streamed lines; (lines, whole texts of the closed ones, open text)."""
    lines, whole, text = [], [], ""
    for i in range(n):
        part = f"<{i}>" * rng.randrange(1, 6)
        closes = i < n - 8 and rng.random() < 0.2
        lines.append(json.dumps({"type": "assistant", "message": {"stop_reason": "end_turn" if closes else None, "content": [{"type": "text", "text": part}]}}))
        text += part
        if closes:
            whole.append(text)
            text = ""
    return lines, whole, text


@pytest.mark.parametrize("limit", [1, 40, 1000])
def test_pieces_of_long_texts_are_the_text(as_lines, limit):
    lines, whole, rest = split_messages(random.Random(limit), 160)
    turns = A.merge_turns(A.turn_rows(as_lines({"s": lines, "t": lines[:9]}, 5)), limit).where("session_id = 's'").orderBy("off").collect()
    texts, text = [], ""
    for r in turns:
        text += r.text
        if r.end is not None:
            texts.append(text)
            text = ""
    assert (texts, text) == (whole, rest)
    assert [r.tail for r in turns] == [False] * (len(turns) - 1) + [True]
    # texts under the limit are one row
    if limit == 1000:
        assert len(turns) == len(whole) + 1
    assert max(len(r.text) for r in turns) < limit + 40


def test_pieces_keep_their_own_lines_in_the_records(as_lines, monkeypatch):
    monkeypatch.setattr(A.merge_turns, "__defaults__", (50,))
    lines, whole, rest = split_messages(random.Random(3), 120)
    rows = A.records(as_lines({"s": lines}, 6)).orderBy("unit", "seq").collect()
    assert "".join(r.content for r in rows) == "".join(whole) + rest
    assert len({r.unit for r in rows}) == len(rows) > len(whole) + 1
    assert rows[-1].unit == len(lines) - 1


@pytest.mark.parametrize("ascending", [True, False])
def test_a_large_page_of_a_hot_session(spark, ascending):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 700).cast("string"))).alias("session_id"),
        F.floor(F.col("id") / 1000).cast("bigint").alias("chunk"), F.floor(F.col("id") / 6).cast("bigint").alias("unit"), F.col("id").alias("seq"),
    )
    page = T.forward_page(rows, 5000) if ascending else T.backward_page(rows, 5000)
    units = rows.groupBy("session_id", "unit").agg(F.count("*").alias("n"))
    order = F.col("unit").asc() if ascending else F.col("unit").desc()
    taken = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = rows.join(units.withColumn("taken", taken).where("taken < 5000"), ["session_id", "unit"], "left_semi")
    assert sorted(r.seq for r in page.collect()) == sorted(r.seq for r in want.collect())
    # one window adds up the counts of a session's chunks, the other ranks units inside a chunk
    windows = [x.split("windowspecdefinition(")[1] for x in page._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in x]
    assert len(windows) == 2 and all(", chunk#" in w.split(" ASC")[0].split(" DESC")[0] for w in windows)


def test_positions_of_a_session_on_one_day_spread_over_tasks(spark):
    rows = spark.range(40_000).select(
        F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("session_id"),
        F.lit("{}").alias("data"), (F.lit(1_767_225_600_000) + (F.col("id") * 7919) % 40_009).alias("time_created"),
    )
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = C.message_positions(rows, 500)
        hot = got.where("session_id = 'hot'").select("id", "position", "chunk", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])
    at = {r.id: r.time_created for r in rows.where("session_id = 'hot'").collect()}
    order = sorted(at, key=lambda i: (at[i], i))
    assert {r.id: r.position for r in hot} == {i: n for n, i in enumerate(order)}
    assert len({r.p for r in hot}) >= 8
    sizes = [sum(r.chunk == c for r in hot) for c in {r.chunk for r in hot}]
    assert max(sizes) <= 2 * 500 < CHUNK_ROWS


def test_equal_times_and_small_sessions_keep_their_positions(spark):
    rows = [(f"m{i:03d}", "one" if i % 2 else "two", "{}", None if i % 7 == 0 else 5 if i < 60 else i) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, session_id string, data string, time_created bigint")
    for size in (10, 1000):
        got = {r.id: r.position for r in C.message_positions(df, size).collect()}
        for s in ("one", "two"):
            own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
            assert [got[r[0]] for r in own] == list(range(len(own)))
