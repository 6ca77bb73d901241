"""Inputs at the edges that earlier rounds refused or read wrongly."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from chatstream.functions.strict_json import instant
from chatstream.functions.text import first_match
from chatstream.functions.urls import safe_socket_url
from chatstream.operators import ratelimit, rooms
from chatstream.operators.ordered import Spread


@pytest.mark.parametrize("rate", [1500, 1001, 33.337, "0.123456789", Fraction(10**9 + 7, 3)])
@pytest.mark.parametrize("spread", [Spread(width_us=2_000), Spread(width_us=10**12)])
def test_any_positive_rate(spark, rate, spread):
    times = [1_700_000_000_000_000 + k * 137 for k in range(120)]
    frame = spark.createDataFrame([(k, "u", t) for k, t in enumerate(times)], "event_id long, user_id string, t_us long")
    found = [r.allowed for r in ratelimit.rate_limit(frame, rate, 2, spread=spread).orderBy("event_id").collect()]
    exact, tokens, before, want = Fraction(str(rate)) if isinstance(rate, float) else Fraction(rate), Fraction(2), times[0], []
    for t in times:
        tokens, before = min(Fraction(2), tokens + exact * (t - before) / 10**6), t
        want.append(tokens >= 1)
        tokens -= tokens >= 1
    assert found == want


def test_dictionary_words_are_trimmed_like_texts_and_of_any_number(spark):
    frame = spark.createDataFrame([("say \x1cbar",), ("bar",), ("w77 w9",), (None,)], "c string")
    assert [r[0] for r in frame.select(first_match(F.col("c"), ["\x1cbar", " "])).collect()] == ["\x1cbar", None, None, None]
    many = [f"w{k}" for k in range(100)]
    assert [r[0] for r in frame.select(first_match(F.col("c"), many)).collect()] == [None, None, "w7", None]


def test_socket_addresses(spark):
    good = ["ws://gate:8443/live", "WSS://[2001:db8::7]:90", "wss://gate/a b", "wss://gate/x|y{z}", "ws://gate?", "ws://gäte/%C3%A4", "ws://gate:/"]
    bad = ["wss://gate:port/ws", "http://gate", "ws://", "ws:///x", "ws://me@gate", "ws://gate?x=1", "ws://gate#x", "ws://gate/%zz", "ws://ga te/", "ws://gate/\x01", "gate", "", None]
    frame = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r[0] for r in frame.select(safe_socket_url(F.col("u"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_offsets_up_to_a_day(spark):
    given = ["2024-05-01T10:00:00+19:00", "2024-05-01T10:00:00.5-23:59", "2024-05-01T10:00:00Z", "2024-05-01T10:00:00+24:00", "2024-05-01T10:00:00+05:60", None]
    frame = spark.createDataFrame([(v,) for v in given], "v string")
    rows = [r[0] for r in frame.select(F.date_format(instant(F.col("v")), "yyyy-MM-dd HH:mm:ss.S")).collect()]
    assert rows == ["2024-04-30 15:00:00.0", "2024-05-02 09:59:00.5", "2024-05-01 10:00:00.0", None, None, None]


def test_a_text_is_lowered_once_for_all_words(spark):
    frame = spark.createDataFrame([("x",)], "c string")
    plan = frame.select(first_match(F.col("c"), ["a", "b"]).alias("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(array(lower(" in plan and plan.count("lower(") == 1


def test_messages_meet_members_under_the_trimmed_room_name(spark):
    stays = spark.createDataFrame([("r", "a", 0, 1, None, None)], "room_id string, user_id string, joined_at long, join_id long, left_at long, leave_id long")
    spoken = spark.createDataFrame([(" r ", "b", 5, 50, 1)], "room_id string, user_id string, event_id long, t_us long, off long")
    assert rooms.heard(spoken, stays).count() == 1
    assert [(r.room_id, r.member_id) for r in rooms.fanout(spoken, stays).collect()] == [("r", "a")]
