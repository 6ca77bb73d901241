import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatstream.operators import delivery, metrics
from chatstream.operators.ordered import Spread


def test_echo_parsing(spark, rows):
    data = [("u", "loadtest:u:5", 9), ("u", "loadtest:x:5", 9), ("u", "loadtest:u:5:6", 9), ("u", "loadtest:u", 9), ("u", "hello", 9), ("u", "loadtest:u:abc", 9),
            ("u", "loadtest:u: 5", 9), ("u", "loadtest:u:1.5", 9), ("u", "loadtest:u:", 9), ("u", "loadtest:u:9223372036854775808", 9), ("u", "loadtest:u:+7", 9), ("u", "other:u:5", 9)]
    df = spark.createDataFrame(data, "user_id string, content string, received_ns long")
    assert rows(delivery.parse_echo(df), "sent_ns", "latency_ns") == [(5, 4), (7, 2)]


def test_same_id_twice_counts_one_delivery(spark):
    sent = spark.createDataFrame([("u", "loadtest:u:5"), ("u", "loadtest:u:6")], "user_id string, content string")
    got = spark.createDataFrame([("u", "loadtest:u:5", 9), ("u", "loadtest:u:5", 7), ("u", "x", 7)], "user_id string, content string, received_ns long")
    errors = spark.createDataFrame([("write",), ("read",), ("read",)], "kind string")
    row = delivery.delivery_report(sent, got, errors).first()
    assert (row.sent, row.received, row.self_delivered, row.duplicates, row.delivery_rate, row.max_latency_ns) == (2, 3, 1, 1, 50.0, 2)
    assert (row.write_errors, row.read_errors) == (1, 2)
    assert [(r.content, r.copies) for r in delivery.sent_delivery(sent, got).orderBy("content").collect()] == [("loadtest:u:5", 2), ("loadtest:u:6", 0)]


def test_empty_report(spark):
    empty = spark.createDataFrame([], "user_id string, content string, received_ns long")
    row = delivery.delivery_report(empty, empty).first()
    assert (row.sent, row.self_delivered, row.duplicates, row.delivery_rate, row.max_latency_ns) == (0, 0, 0, 0.0, None)


def test_percentile_takes_the_floor_index(spark, rows):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "v long")
    assert rows(delivery.floor_percentiles(df, "v", [50, 95, 99, 0, 100])) == [(0, 1), (50, 5), (95, 9), (99, 9), (100, 10)]


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_by_group(spark, rows, seed):
    rng = random.Random(seed)
    data = [(rng.choice("ab"), rng.choice([rng.randrange(-(2**62), 2**62), rng.randrange(100), 7])) for _ in range(500)]
    got = rows(delivery.floor_percentiles(spark.createDataFrame(data, "k string, v long"), "v", [50, 95, 99], by=["k"]), "k", "percent", "v")
    want = []
    for k in "ab":
        values = sorted(v for g, v in data if g == k)
        want += [(k, p, values[(len(values) - 1) * p // 100]) for p in (50, 95, 99)]
    assert got == want


def test_histogram_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.005,), (0.0050001,), (10.0,), (11.0,), (None,)], "s double")
    got = {(r.metric, r.labels): float(r.value) for r in metrics.latency_histogram(df, "s", "m").collect()}
    assert got[("m_bucket", 'le="0.005"')] == 1 and got[("m_bucket", 'le="0.01"')] == 2 and got[("m_bucket", 'le="10"')] == 3
    assert got[("m_bucket", 'le="+Inf"')] == 4 and got[("m_count", "")] == 4 and got[("m_sum", "")] == pytest.approx(21.0100001)


def test_counters_and_lines(spark):
    df = spark.createDataFrame([(None,), ("frame_too_large",), ("rate_limit",), ("rate_limit",)], "reject_reason string")
    lines = {r.line for r in metrics.metrics_lines(metrics.frame_counters(df)).collect()}
    assert lines == {
        "chatstream_messages_received_total 3",
        'chatstream_messages_rejected_total{reason="frame_too_large"} 1',
        'chatstream_messages_rejected_total{reason="rate_limit"} 2',
    }
    none = metrics.metrics_lines(metrics.frame_counters(df.limit(0))).collect()
    assert [r.line for r in none] == ["chatstream_messages_received_total 0"]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_connection_gauge(spark, rows, width):
    df = spark.createDataFrame([(1, 1, 1), (2, 2, 1), (3, 3, -1), (9, 4, 1)], "t_us long, event_id long, delta long")
    assert rows(metrics.connections_gauge(df, Spread(width_us=width)), "event_id", "connections") == [(1, 1), (2, 2), (3, 1), (4, 2)]
    row = metrics.connections_peak(df, Spread(width_us=width)).first()
    assert (row.peak, row.current, row.opened) == (2, 2, 3)


def test_consumer_state(spark):
    data = [(0, 1, 1, "running"), (0, 2, 2, "ready"), (0, 3, 3, "restart"), (1, 1, 4, "running"), (1, 2, 5, "ready"), (2, 1, 6, "running"), (2, 5, 7, "stopped")]
    df = spark.createDataFrame(data, "instance_id int, t_us long, event_id long, kind string")
    got = {r.instance_id: (r.running, r.ready, r.restarts) for r in metrics.consumer_state(df).collect()}
    assert got == {0: (1, 0, 1), 1: (1, 1, 0), 2: (0, 0, 0)}


def test_access_levels(spark):
    df = spark.createDataFrame([("GET", "/ws?token=secret", s, 1.5) for s in (200, 302, 400, 499, 500)], "method string, path string, status int, latency_ms double")
    got = {r.status: (r.path, r.level) for r in metrics.access_log(df).collect()}
    assert {v[0] for v in got.values()} == {"/ws"}
    assert [got[s][1] for s in (200, 302, 400, 499, 500)] == ["info", "info", "warn", "warn", "error"]


@pytest.mark.parametrize("spread", [Spread(mode="hot"), Spread(width_us=7, mode="hot", hot_share=0, hot_min_rows=0)])
def test_liveness(spark, rows, spread):
    data = [(1, 0, 0), (1, 1, 60), (1, 2, 121), (2, 3, 0)]
    df = spark.createDataFrame(data, "conn_id long, event_id long, t_us long")
    assert rows(metrics.liveness_timeouts(df, 60, spread=spread), "conn_id", "last_us", "timed_out_us") == [(1, 60, 120)]
    assert rows(metrics.liveness_timeouts(df, 60, until_us=150, spread=spread), "conn_id", "last_us", "timed_out_us") == [(1, 60, 120), (2, 0, 60)]
