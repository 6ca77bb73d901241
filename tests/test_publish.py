from pyspark.sql import functions as F

from chatstream.operators import publish, ratelimit
from chatstream.operators.ordered import Spread


def test_readiness_at_an_instant(spark, rows):
    log = spark.createDataFrame(
        [(0, 10, 1, "running"), (0, 20, 2, "ready"), (0, 30, 3, "restart"), (0, 40, 4, "ready"), (0, 45, 5, "running"), (1, 5, 6, "ready")],
        "instance_id int, t_us long, event_id long, kind string")
    probes = spark.createDataFrame([(i, 0, t) for i, t in enumerate([5, 15, 20, 29, 30, 50])] + [(9, 1, 5), (10, 2, 50)], "i int, instance_id int, t_us long")
    for width in (1, 12, 1000):
        got = publish.with_readiness(probes, log, Spread(width_us=width))
        assert rows(got, "i", "bus_ready") == [(0, False), (1, False), (2, True), (3, True), (4, False), (5, True), (9, True), (10, False)]


def test_reasons_in_order(spark):
    data = [("rate_limit", False, None, False), (None, False, None, False), (None, None, "m", True), (None, True, "", False), (None, True, None, True), (None, True, "m", False), (None, True, "m", True)]
    df = spark.createDataFrame(data, "r string, ready boolean, id string, done boolean")
    got = [x[0] for x in df.select(publish.publish_reason(F.col("r"), F.col("ready"), F.col("id"), F.col("done"))).collect()]
    assert got == ["rate_limit", "message_bus_unavailable", "message_bus_unavailable", "message_id_generation_failed",
                   "message_id_generation_failed", "message_bus_unavailable", None]


def test_one_bucket_per_gateway(spark):
    df = spark.createDataFrame([("u", 0, i, g) for i, g in enumerate("aabb")], "user_id string, t_us long, event_id long, gateway string")
    assert [r.allowed for r in ratelimit.rate_limit(df, 1, 1, per="gateway").orderBy("event_id").collect()] == [True, False, True, False]
    assert [r.allowed for r in ratelimit.rate_limit(df, 1, 1).orderBy("event_id").collect()] == [True, False, False, False]
