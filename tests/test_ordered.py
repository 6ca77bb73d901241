import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chatstream.operators.ordered import ALL, HOT, Running, Spread, as_of, hot_keys, running

SPREADS = {
    "one piece": HOT,
    "hot key cut": Spread(width_us=20_000, mode="hot", hot_share=0.3, hot_min_rows=5),
    "every key cut as hot": Spread(width_us=20_000, mode="hot", hot_share=0, hot_min_rows=0),
    "all cut": Spread(width_us=20_000),
    "one row per slice": Spread(width_us=1),
}


@pytest.fixture(scope="module")
def line(spark):
    rng = random.Random(7)
    data = [(rng.choice("aaaabc"), rng.randrange(300) * 1000, i, rng.randrange(5)) for i in range(2000)]
    return spark.createDataFrame(data, "k string, t_us long, event_id long, v long").withColumn("w", F.when(F.col("v") > 2, F.col("v")))


def check_running(line, keys, spread):
    forward = W.partitionBy(*keys).orderBy("t_us", "event_id")
    backward = W.partitionBy(*keys).orderBy(F.desc("t_us"), F.desc("event_id"))
    want = line.select(
        "*",
        F.sum("v").over(forward.rowsBetween(W.unboundedPreceding, 0)).alias("total"),
        F.last("w", True).over(forward.rowsBetween(W.unboundedPreceding, 0)).alias("latest"),
        F.last("w", True).over(forward.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.last("w", True).over(backward.rowsBetween(W.unboundedPreceding, -1)).alias("after"),
    )
    got = running(
        line, keys, "t_us", ["t_us", "event_id"],
        Running(sums={"total": "v"}, last={"latest": "w"}, prev={"before": "w"}, next={"after": "w"}), spread,
    ).select(want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", SPREADS)
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_equals_plain_window(line, name, keys):
    spread = SPREADS[name]
    if not keys and spread.mode == "hot":
        pytest.skip("hot keys need a key")
    check_running(line, keys, spread)


def test_hot_keys_are_bounded_by_the_share(line):
    found = {r.k for r in hot_keys(line, ["k"], Spread(mode="hot", hot_share=0.5, hot_min_rows=1)).collect()}
    assert found == {"a"}
    assert hot_keys(line, ["k"], HOT).count() == 0


@pytest.fixture(scope="module")
def burst(spark):
    """Two thirds of all rows, most of one key, within a thousandth of the time."""
    rng = random.Random(2)
    data = [("a" if rng.random() < 0.9 else "b", 500_000_000 + rng.randrange(1_000_000), i, 1) for i in range(2000)]
    data += [(rng.choice("abc"), rng.randrange(1_000_000_000), 2000 + i, 1) for i in range(1000)]
    return spark.createDataFrame(data, "k string, t_us long, event_id long, v long").withColumn("w", F.when(F.col("event_id") % 5 == 0, F.col("event_id")))


def test_fit_bounds_rows_per_slice_in_a_burst(burst):
    spread = Spread.fit(burst, "t_us", rows_per_slice=50)
    assert len(spread.dense) >= 1
    sliced = spread.add_slice(burst, "t_us")
    assert sliced.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 200
    late = sliced.select("_slice", F.lag("_slice").over(W.orderBy("t_us")).alias("p")).where("_slice < p")
    assert late.count() == 0
    assert Spread.fit(burst.limit(0), "t_us") == ALL


@pytest.mark.parametrize("settings", [{}, {"mode": "hot", "hot_share": 0.5, "hot_min_rows": 5}])
def test_running_over_fitted_slices(burst, settings):
    spread = Spread.fit(burst, "t_us", rows_per_slice=50, **settings)
    check_running(burst, ["k"], spread)


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_as_of(spark, rows, width):
    log = spark.createDataFrame([("a", 10, 1, "x"), ("a", 20, 2, None), ("b", 5, 3, "z"), ("a", 20, 4, "y")], "k string, t_us long, event_id long, v string")
    probes = spark.createDataFrame([(1, "a", 9), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "a", 5000), (6, "b", 5), (7, "c", 5)], "i int, k string, t_us long")
    spread = Spread(width_us=width)
    got = as_of(probes, log, ["k"], "t_us", ["v"], log_order="event_id", spread=spread)
    assert rows(got, "i", "v") == [(1, None), (2, "x"), (3, "x"), (4, "y"), (5, "y"), (6, "z"), (7, None)]
    strictly = as_of(probes, log, ["k"], "t_us", ["v"], log_order="event_id", log_first=False, spread=spread)
    assert rows(strictly, "i", "v")[1] == (2, None) and rows(strictly, "i", "v")[3] == (4, "x")


def test_rows_are_shuffled_once(spark, line):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = running(line, ["k"], "t_us", ["t_us", "event_id"], Running(sums={"total": "v"}, prev={"before": "w"}), Spread(width_us=1000))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the rows by cell; the summary by cell, by key, and back by cell
    assert plan.count("Exchange hashpartitioning") == 4
    whole = running(line, ["k"], "t_us", ["t_us", "event_id"], Running(sums={"total": "v"}), HOT)
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
