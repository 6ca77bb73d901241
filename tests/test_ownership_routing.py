import pytest
from pyspark.sql import functions as F

from chatstream.functions.hashing import fnv1a32, partition_for_room
from chatstream.functions.urls import valid_lease
from chatstream.operators import ownership, routing
from chatstream.operators.ordered import Spread

OWNERS = "event_id long, t_us long, part int, instance_id int"
LEASES = "event_id long, t_us long, part int, kind string, gateway_id string, websocket_url string, token string, ttl_us long"
SPREADS = [Spread(width_us=w) for w in (1, 15, 10_000)]


def test_fnv_vectors(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",), ("房间",)], "k string").select(fnv1a32(F.col("k"))).collect()
    h = 2166136261
    for b in "房间".encode():
        h = (h ^ b) * 16777619 % 2**32
    assert [r[0] for r in got] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, h]


def test_partition_for_room(spark):
    df = spark.createDataFrame([(f"room-{i}",) for i in range(200)] + [(" ",), ("",), (None,)], "room_id string")
    got = {r.room_id: r.p for r in df.select("room_id", partition_for_room(F.col("room_id"), [4, 7, 9]).alias("p")).collect()}

    def want(room):
        h = 2166136261
        for b in room.encode():
            h = (h ^ b) * 16777619 % 2**32
        return [4, 7, 9][abs(h - 2**32 if h >= 2**31 else h) % 3]

    assert all(got[f"room-{i}"] == want(f"room-{i}") for i in range(200))
    assert got[" "] is None and got[""] is None and got[None] is None
    assert {r.p for r in df.select(partition_for_room(F.col("room_id"), []).alias("p")).collect()} == {None}


@pytest.fixture
def owners(spark):
    """Change 1 assigns, change 2 moves partition 1, change 3 clears all, change 4 gives back."""
    data = [(1, 10, 0, 0), (1, 10, 1, 1), (1, 10, 2, 0), (2, 20, 0, 0), (2, 20, 1, 0), (2, 20, 2, 0),
            (3, 30, 0, None), (3, 30, 1, None), (3, 30, 2, None), (4, 40, 0, 1), (4, 40, 1, 0), (4, 40, 2, 1)]
    return spark.createDataFrame(data, OWNERS)


@pytest.mark.parametrize("spread", SPREADS)
def test_revisions_count_clears(owners, rows, spread):
    assert rows(ownership.revisions(owners, spread), "event_id", "revision", "cleared") == [(1, 1, 0), (2, 2, 0), (3, 3, 3), (4, 4, 0)]


def test_assigned_partitions_are_sorted(owners, rows):
    got = {(r.event_id, r.instance_id): r.partitions for r in ownership.assigned_partitions(owners).collect()}
    assert got[(1, 0)] == [0, 2] and got[(4, 1)] == [0, 2] and (3, 0) not in got


@pytest.mark.parametrize("spread", SPREADS)
def test_owner_and_revision_at_an_instant(spark, owners, rows, spread):
    probes = spark.createDataFrame([(i, t, 1) for i, t in enumerate([9, 10, 19, 20, 35, 99])], "i int, t_us long, part int")
    assert rows(ownership.with_owner(probes, owners, spread), "i", "instance_id") == [(0, None), (1, 1), (2, 1), (3, 0), (4, None), (5, 0)]
    assert rows(ownership.with_revision(probes, owners, spread), "i", "revision") == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4)]


@pytest.mark.parametrize("spread", SPREADS)
def test_every_change_closes_open_connections(spark, owners, rows, spread):
    data = [(1, 5, 8), (2, 5, None), (3, 10, 15), (4, 10, 20), (5, 25, 60), (6, 41, None)]
    conns = spark.createDataFrame(data, "join_id long, joined_at long, left_at long")
    assert rows(ownership.rebalance_closed(conns, owners, spread), "join_id", "closed_at", "by_rebalance") == [
        (1, 8, False), (2, 10, True), (3, 15, False), (4, 20, False), (5, 30, True), (6, None, False)]


def test_handshake_recheck(spark, owners, rows):
    data = [(1, 12, 15), (2, 12, 20), (3, 1, 5), (4, 1, 50)]
    df = spark.createDataFrame(data, "event_id long, t_us long, registered_us long")
    assert rows(ownership.handshake_recheck(df, owners), "event_id", "accepted") == [(1, True), (2, False), (3, True), (4, False)]


def test_reconcile_follows_ownership(owners, rows):
    got = rows(ownership.lease_reconcile(owners).where("event_id > 1"), "event_id", "part", "instance_id", "action")
    assert got == [
        (2, 0, 0, "register"), (2, 1, 0, "register"), (2, 1, 1, "release"), (2, 2, 0, "register"),
        (3, 0, 0, "release"), (3, 1, 0, "release"), (3, 2, 0, "release"),
        (4, 0, 1, "register"), (4, 1, 0, "register"), (4, 2, 1, "register")]


def test_assignment_outside_topic_and_shared_ownership(spark, rows):
    available = spark.createDataFrame([(1, 0), (1, 1)], "event_id long, part int")
    assigned = spark.createDataFrame([(1, 2, 0), (1, 0, 0)], "event_id long, part int, instance_id int")
    assert rows(ownership.assignment_violations(assigned, available), "part") == [(2,)]
    claims = spark.createDataFrame([(1, 0, 0), (1, 0, 1)], "event_id long, part int, instance_id int")
    assert rows(ownership.ownership_exclusive(claims, available), "part", "owners", "problem") == [(0, 2, "duplicate"), (1, 0, "missing")]


def lease_rows(spark, *ops):
    url = "wss://g.example/ws"
    return spark.createDataFrame([(i, t, 0, kind, f"gw-{token}", url, token, ttl) for i, (t, kind, token, ttl) in enumerate(ops)], LEASES)


@pytest.mark.parametrize("spread", [*SPREADS, Spread(width_us=10, hot_share=0, hot_min_rows=0)])
def test_lease_life(spark, rows, spread):
    log = lease_rows(
        spark, (10, "register", "A", 100), (20, "register", "B", 100), (30, "release", "A", 0), (40, "release", "B", 0),
        (50, "register", "A", 80), (200, "release", "A", 0), (300, "register", " ", 80), (310, "register", "C", 50), (330, "register", "C", 50),
        (335, "release", "B", 0), (340, "release", "C", 0),
    )
    probes = spark.createDataFrame([(100 + t, t, p) for t, p in [(5, 0), (15, 0), (35, 0), (45, 0), (60, 0), (129, 0), (130, 0), (250, 0), (305, 0), (336, 0), (345, 0), (15, 1)]],
                                   "event_id long, t_us long, part int")
    got = rows(routing.route_lookup(probes, log, spread), "part", "t_us", "status", "gateway_id")
    assert got == [
        (0, 5, "never", None), (0, 15, "live", "gw-A"), (0, 35, "live", "gw-B"), (0, 45, "released", None), (0, 60, "live", "gw-A"),
        (0, 129, "live", "gw-A"), (0, 130, "expired", None), (0, 250, "expired", None), (0, 305, "expired", None),
        (0, 336, "live", "gw-C"), (0, 345, "released", None), (1, 15, "never", None)]


def test_token_never_leaves(spark):
    log = lease_rows(spark, (10, "register", "A", 100))
    probes = spark.createDataFrame([(9, 11, 0)], "event_id long, t_us long, part int")
    assert routing.route_lookup(probes, log).columns == ["event_id", "t_us", "part", "status", "gateway_id", "websocket_url"]


@pytest.mark.parametrize("url, ok", [
    ("wss://gateway.example/ws", True), ("ws://localhost:9090/ws", True), ("WSS://gateway.example", True), ("wss://my_gw:80/ws", True),
    ("https://gateway.example/ws", False), ("wss://u:p@gateway.example/ws", False), ("wss://gateway.example/ws?token=x", False),
    ("wss://gateway.example/ws#f", False), ("javascript:alert(1)", False), ("wss:///ws", False), ("", False), (None, False), ("wss://a b/", False),
])
def test_safe_addresses(spark, url, ok):
    df = spark.createDataFrame([(url, "g", "t"), (url, " ", "t"), (url, "g", "")], "u string, g string, t string")
    assert [r[0] for r in df.select(valid_lease(F.col("g"), F.col("u"), F.col("t"))).collect()] == [ok, False, False]


def test_lease_key(spark):
    df = spark.createDataFrame([(" p:x: ",), ("",), (None,), ("p::",)], "prefix string")
    got = [r[0] for r in df.select(routing.lease_key(F.col("prefix"), F.lit("chat"), F.lit("g"), F.lit(3))).collect()]
    assert got == ["p:x:chat:g:partition:3", "chatstream:routing:chat:g:partition:3", "chatstream:routing:chat:g:partition:3", "p::chat:g:partition:3"]


def test_route_of_a_room(spark):
    part = spark.range(1).select(partition_for_room(F.lit("r"), [0, 1, 2]).alias("p")).first().p
    log = spark.createDataFrame(
        [(1, 10, part, "register", "gw", "wss://g.test/ws", "t", 100), (2, 50, part, "release", "gw", "", "other", 0), (3, 60, part, "release", "gw", "", "t", 0)],
        "event_id long, t_us long, part int, kind string, gateway_id string, websocket_url string, token string, ttl_us long")
    asked = spark.createDataFrame([(11, 5, "r"), (12, 20, " r\t"), (13, 55, "r"), (14, 70, "r"), (15, 20, " "), (16, 20, None)], "event_id long, t_us long, room_id string")
    got = {r.event_id: tuple(r)[3:] for r in routing.route_requests(asked, log, [0, 1, 2]).collect()}
    live, gone = (200, part, "gw", "wss://g.test/ws"), (503, None, None, None)
    assert got == {11: gone, 12: live, 13: live, 14: gone, 15: (400, None, None, None), 16: (400, None, None, None)}
    assert all(r.http_status in (400, 503) for r in routing.route_requests(asked, log, []).collect())
    assert "token" not in routing.route_requests(asked, log, [0]).columns
