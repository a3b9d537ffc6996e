import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skeinlog.operators.ordered import LastValue, RunningSum, first_per_group, ordered_scan, row_position, with_chunk


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_chunked_scan_equals_one_window(spark, width):
    rnd = random.Random(7)
    # one hot session next to small ones
    rows = [("hot" if i % 3 else f"s{i % 5}", i, rnd.randint(-5, 9), rnd.choice([None, "a", "b", "c"])) for i in range(300)]
    df = with_chunk(spark.createDataFrame(rows, "k string, pos bigint, n bigint, v string"), "pos", width)
    specs = [
        RunningSum("run", F.col("n")),
        RunningSum("before", F.col("n"), inclusive=False),
        LastValue("seen", F.col("v")),
        LastValue("prev", F.col("v"), inclusive=False),
    ]
    got = ordered_scan(df, ["k"], ["pos"], specs).drop("chunk")
    w = Window.partitionBy("k").orderBy("pos")
    upto, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.drop("chunk").select(
        "*",
        F.sum("n").over(upto).alias("run"),
        F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"),
        F.last("v", True).over(upto).alias("seen"),
        F.last("v", True).over(prior).alias("prev"),
    )
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_row_position_counts_from_zero(spark):
    df = with_chunk(spark.range(10).withColumn("k", F.lit("x")), "id", 4)
    assert [r.p for r in row_position(df, ["k"], ["id"], "p").orderBy("id").collect()] == list(range(10))


def test_group_limit_is_pushed_below_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    plan = first_per_group(df, ["k"], ["id"], 5, "r")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
