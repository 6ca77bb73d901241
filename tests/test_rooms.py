import random

import pytest
from pyspark.sql import functions as F

from chatstream.operators import rooms
from chatstream.operators.ordered import HOT, Spread
from chatstream.plans import flow, queries

LOG = "event_id long, t_us long, room_id string, user_id string, kind string"
MESSAGES = "event_id long, t_us long, room_id string, user_id string, content string, off long"


def log(spark, *steps):
    return spark.createDataFrame([(i, t, room, user, kind) for i, (t, room, user, kind) in enumerate(steps)], LOG)


def messages(spark, *said):
    return spark.createDataFrame([(100 + i, t, room, user, f"c{i}", i) for i, (t, room, user) in enumerate(said)], MESSAGES)


def test_membership_rules(spark, rows):
    moves = log(
        spark, (1, " room-a ", "alice", "join"), (2, "room-a", "alice", "join"), (3, "room-a", "alice", "leave"), (4, "room-a", "alice", "leave"),
        (5, "room-a", "bob", "join"), (6, "  ", "x", "join"), (7, "room-a", " ", "join"), (8, "room-a", "alice", "join"), (9, "room-a", "", "leave"),
    )
    got = rooms.membership_intervals(moves)
    assert rows(got, "room_id", "user_id", "joined_at", "left_at") == [
        ("room-a", "alice", 1, 3), ("room-a", "alice", 8, None), ("room-a", "bob", 5, None)]
    assert rows(rooms.membership_rejects(moves), "event_id", "outcome") == [
        (1, "already_joined"), (3, "client_not_found"), (5, "empty_room_id"), (6, "empty_client_id"), (8, "client_not_found")]


def test_two_members_get_sequences_one_and_two(spark, rows):
    moves = log(spark, (1, "r", "a", "join"), (2, "r", "b", "join"), (50, "r", "b", "leave"), (1, "other", "c", "join"))
    said = messages(spark, (0, "r", "a"), (10, "r", "a"), (20, "r", "b"), (50, "r", "a"), (10, "empty", "z"))
    intervals = rooms.membership_intervals(moves)
    delivered = flow.deliver(said, intervals)
    assert rows(delivered, "room_id", "sequence", "event_id", "member_id") == [
        ("r", 1, 101, "a"), ("r", 1, 101, "b"), ("r", 2, 102, "a"), ("r", 2, 102, "b"), ("r", 3, 103, "a")]
    assert rows(rooms.unheard(said, intervals), "event_id") == [(100,), (104,)]


def test_slow_client_misses_one(spark, rows):
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b")], "event_id long, member_id string")
    received = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "event_id long, member_id string")
    missed = rooms.missed_deliveries(expected, received)
    assert rows(missed) == [(2, "b")]
    assert rows(rooms.dropped_clients(missed)) == [(2, 1)]


@pytest.fixture(scope="module")
def busy(spark):
    """One room with most of the traffic."""
    rng = random.Random(11)
    pick = lambda: rng.choice(["hot"] * 4 + ["a", "b"])
    moves = [(i, rng.randrange(1000), pick(), f"u{rng.randrange(6)}", rng.choice(["join", "leave"])) for i in range(400)]
    said = sorted(rng.randrange(1000) for _ in range(300))
    return moves, [(1000 + i, t, pick(), "u", f"c{i}", i) for i, t in enumerate(said)]


def simulate(moves, said):
    """The rooms one event at a time; members move first at one instant."""
    present, count, out = {}, {}, []
    line = sorted([(t, 0, i, room, user, kind) for i, t, room, user, kind in moves] + [(t, 1, i, room, None, None) for i, t, room, *_ in said])
    for _, rank, i, room, user, kind in line:
        members = present.setdefault(room, set())
        if rank == 0:
            (members.add if kind == "join" else members.discard)(user)
        elif members:
            count[room] = count.get(room, 0) + 1
            out += [(i, count[room], m) for m in members]
    return sorted(out)


@pytest.mark.parametrize("membership, audience, offsets, slice_us", [
    (HOT, Spread(width_us=10_000), 1_000, 3_600_000_000),
    (Spread(width_us=50, mode="hot", hot_share=0, hot_min_rows=0), Spread(width_us=30), 20, 40),
    (Spread(width_us=100, mode="hot", hot_share=0.02, hot_min_rows=3), Spread(width_us=1), 1, 7),
])
def test_skewed_rooms_match_a_simulation(spark, rows, busy, membership, audience, offsets, slice_us):
    moves, said = busy
    intervals = rooms.membership_intervals(spark.createDataFrame(moves, LOG), membership)
    heard = rooms.heard(spark.createDataFrame(said, MESSAGES), intervals, audience)
    delivered = rooms.fanout(rooms.room_sequence(heard, offsets), intervals, slice_us)
    assert rows(delivered, "event_id", "sequence", "member_id") == simulate(moves, said)
    assert delivered.groupBy("event_id").agg(F.count("*").alias("n"), F.max("audience").alias("a")).where("n <> a").count() == 0


def test_order_violations(spark, rows):
    df = spark.createDataFrame([("r", 1, 1), ("r", 2, 3), ("r", 3, 2), ("r", 4, 4), ("s", 1, 9)], "room_id string, t_us long, off long")
    for width in [1, 2, 1000]:
        assert rows(rooms.order_violations(df, ["room_id"], "off", Spread(width_us=width)), "off", "previous") == [(2, 3)]


def test_stays_of_decades_cost_only_the_slices_with_messages(spark):
    """Laid out over every second of fifty years these stays would be billions of rows."""
    year = 31_557_600_000_000
    stays = spark.createDataFrame([(f"r{k % 2}", f"u{k}", 0, k, None if k % 3 else 49 * year, None) for k in range(6)],
                                  "room_id string, user_id string, joined_at long, join_id long, left_at long, leave_id long")
    said = spark.createDataFrame([(i, f"r{i % 2}", t, i) for i, t in enumerate([5, 6, year, 49 * year - 1, 49 * year, 50 * year, 50 * year + 1])],
                                 "event_id long, room_id string, t_us long, sequence long")
    got = sorted((r.event_id, r.member_id) for r in rooms.fanout(said, stays, slice_us=1_000_000).collect())
    want = sorted((i, f"u{k}") for i, t in enumerate([5, 6, year, 49 * year - 1, 49 * year, 50 * year, 50 * year + 1])
                  for k in range(6) if k % 2 == i % 2 and (k % 3 or t < 49 * year))
    assert got == want


@pytest.mark.parametrize("receipts", [1, 64])
def test_missed_deliveries_are_found_inside_the_fan_out(spark, rows, busy, monkeypatch, receipts):
    """The deliveries are never shuffled: what was received comes with the messages."""
    monkeypatch.setattr(rooms, "RECEIPTS", receipts)
    moves, said = busy
    intervals = rooms.membership_intervals(spark.createDataFrame(moves, LOG))
    # one event_id for two messages and one without
    numbered = rooms.room_sequence(spark.createDataFrame([(1000 if i == 1001 else None if i == 1002 else i, *rest) for i, *rest in said], MESSAGES))
    rng = random.Random(3)
    got = [(rng.choice([1000, 1000, None, *range(1000, 1300)]), rng.choice([None, *(f"u{k}" for k in range(6))])) for _ in range(1500)]
    received = spark.createDataFrame(got, "event_id long, member_id string")
    columns = ["event_id", "room_id", "sequence", "member_id"]
    want = rooms.missed_deliveries(rooms.fanout(numbered, intervals, 100), received).select(*columns)
    missed = rooms.missed_deliveries(numbered, received, intervals, 100).select(*columns)
    assert rows(missed) == rows(want) and 0 < missed.count() < rooms.fanout(numbered, intervals, 100).count()
    plan = rooms.dropped_clients(missed)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan


@pytest.mark.parametrize("per_piece, received", [(1, None), (7, None), (7, 3), (4096, None)])
def test_a_crowded_slice_is_dealt_to_pieces(spark, rows, monkeypatch, per_piece, received):
    """However few messages a piece has, each of them meets all stays of its slice once."""
    rng = random.Random(5)
    stays = [("r", f"u{k}", k % 4, k, None if k % 3 else 9, None) for k in range(20)]
    said = [(rng.choice([None, *range(40)]), " r", rng.randrange(12), i) for i in range(90)]
    got = [(e, f"u{k}") for e, *_ in said for k in range(received or 0) if e is not None]
    want = sorted((i, u) for e, _, t, i in said for _, u, joined, _, left, _ in stays
                  if joined <= t and (left is None or t < left) and (e, u) not in got)
    intervals = spark.createDataFrame(stays, "room_id string, user_id string, joined_at long, join_id long, left_at long, leave_id long")
    messages = spark.createDataFrame(said, "event_id long, room_id string, t_us long, sequence long")
    receipts = spark.createDataFrame(got, "event_id long, member_id string") if received else None
    monkeypatch.setattr(rooms, "MESSAGES", per_piece)
    assert rows(rooms.fanout(messages, intervals, received=receipts), "sequence", "member_id") == want


def test_the_fan_out_has_as_many_tasks_as_a_shuffle(spark):
    """Merged by the bytes they read, a few tasks would make all deliveries: their rows are many times what they read."""
    stays = spark.range(300).selectExpr("concat('r', id % 7) AS room_id", "concat('u', id) AS user_id", "0L AS joined_at", "id AS join_id", "cast(null AS bigint) AS left_at", "cast(null AS bigint) AS leave_id")
    said = spark.range(300).selectExpr("id AS event_id", "concat('r', id % 7) AS room_id", "id * 3600000000 AS t_us", "id AS sequence")
    delivered = rooms.fanout(said, stays)
    assert delivered.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert delivered.count() == sum(len(range(r, 300, 7)) ** 2 for r in range(7))


@pytest.mark.parametrize("spread", [HOT, Spread(width_us=3), Spread(mode="hot", width_us=5, hot_share=0, hot_min_rows=0)])
def test_missed_deliveries_are_counted_without_being_laid_out(spark, rows, spread):
    """Ids that repeat or are missing, stays that overlap, hold nobody or end before they begin."""
    rng = random.Random(9)
    stays = [(rng.choice(["r", "s", None]), rng.choice([None, "u0", "u1", "u2", "u3"]), rng.choice([None, *range(12)]), k, rng.choice([None, *range(12)]), None) for k in range(120)]
    said = [(rng.choice([None, *range(25)]), rng.choice([" r", "s ", None]), rng.choice([None, *range(12)]), i) for i in range(80)]
    got = [(rng.choice([None, *range(25)]), rng.choice([None, "u0", "u1", "nobody"])) for _ in range(60)]
    intervals = spark.createDataFrame(stays, "room_id string, user_id string, joined_at long, join_id long, left_at long, leave_id long")
    numbered = spark.createDataFrame(said, "event_id long, room_id string, t_us long, sequence long")
    received = spark.createDataFrame(got, "event_id long, member_id string")
    want = rooms.dropped_clients(rooms.missed_deliveries(numbered, received, intervals, 5))
    counted = rooms.dropped_clients(rooms.missed_deliveries(numbered, received, intervals, counted=spread))
    assert counted.dtypes == want.dtypes
    assert rows(counted) == rows(want) != rows(rooms.dropped_clients(rooms.fanout(numbered, intervals, 5)))


def test_counting_costs_no_row_for_a_missed_delivery(spark):
    """Forty thousand messages to forty thousand members, one of them told: laid out they would be 1.6 thousand million rows."""
    n = 40_000
    stays = spark.range(n).selectExpr("'r' AS room_id", "concat('u', id) AS user_id", "0L AS joined_at", "id AS join_id", "cast(null AS bigint) AS left_at", "cast(null AS bigint) AS leave_id")
    said = spark.range(n).selectExpr("id AS event_id", "'r' AS room_id", "id * 1000000 AS t_us", "id AS sequence")
    received = said.selectExpr("event_id", "'u7' AS member_id")
    missed = rooms.missed_deliveries(said, received, stays, counted=Spread(width_us=1_000_000_000))
    assert [tuple(r) for r in rooms.dropped_clients(missed).agg(F.count("*"), F.min("dropped_clients"), F.max("dropped_clients")).collect()] == [(n, n - 1, n - 1)]


@pytest.mark.parametrize("name", ["dropped_clients", "metrics_scrape"])
def test_queries_that_count_missed_deliveries_make_none(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_there" in plan and "_piece" not in plan


def test_a_stay_is_laid_out_over_a_number_a_day_at_most(spark, monkeypatch):
    """However short the slices are: an array of a number for each minute of fifty years takes a task's memory."""
    widths = []
    monkeypatch.setattr(rooms, "floor_div", lambda c, width, f=rooms.floor_div: widths.append(width) or f(c, width))
    stays = spark.createDataFrame([("r", "u", 0, 1, None, None)], "room_id string, user_id string, joined_at long, join_id long, left_at long, leave_id long")
    said = spark.createDataFrame([(1, "r", 5, 1), (2, "r", 50 * 31_557_600_000_000, 2)], "event_id long, room_id string, t_us long, sequence long")
    for slice_us in (7, 1_000_000, 3_600_000_000):
        widths.clear()
        assert sorted(r.event_id for r in rooms.fanout(said, stays, slice_us).collect()) == [1, 2]
        assert max(widths) >= 86_400_000_000
        assert {b // a for a, b in zip(sorted({*widths}), sorted({*widths})[1:])} == {64}
