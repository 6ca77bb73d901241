"""The joined flow: gate, offsets, a log of files and what comes out of it."""

import json

import pytest
from pyspark.sql import functions as F

from chatstream.operators.ordered import Spread
from chatstream.plans import flow
from chatstream.schema import REASONS
from chatstream.sources import bus

FRAME = "conn_id long, frame_no long, room_id string, user_id string, t_us long, payload string, instance_id int, id_failed boolean, write_failed boolean"


def frame(conn, no, t, payload='{"content":"hi"}', instance=0, id_failed=False, write_failed=False, room="r"):
    return (conn, no, room, f"u{conn}", t, payload, instance, id_failed, write_failed)


def test_every_reason_and_the_order_of_the_gate(spark):
    frames = [
        frame(1, 0, 10), frame(1, 1, 20, "x" * 4097), frame(1, 2, 30), frame(2, 0, 10, "{"), frame(3, 0, 10, '{"content":" "}'),
        frame(4, 0, 10, json.dumps({"content": "a" * 501})), frame(5, 0, 10, '{"content":"a bad word"}'),
        *(frame(6, k, 10 + k) for k in range(3)), frame(7, 0, 10, instance=1), frame(8, 0, 10, id_failed=True), frame(9, 0, 10, write_failed=None),
        frame(10, 0, 10, write_failed=True), frame(11, 0, 10, instance=1, id_failed=True), frame(12, 0, 60, instance=1), frame(13, 0, 4, instance=0),
    ]
    consumers = spark.createDataFrame([(1, 5, 0, "ready"), (2, 5, 1, "ready"), (3, 9, 1, "restart"), (4, 50, 1, "ready")], "event_id long, t_us long, instance_id int, kind string")
    checked = flow.check_frames(spark.createDataFrame(frames, FRAME), ["bad"], 1, 2, consumers=consumers)
    got = {(r.conn_id, r.frame_no): r.reject_reason for r in checked.collect()}
    assert got == {
        (1, 0): None, (1, 1): "frame_too_large", (2, 0): "invalid_json", (3, 0): "empty_content", (4, 0): "content_too_long", (5, 0): "sensitive_content",
        (6, 0): None, (6, 1): None, (6, 2): "rate_limit", (7, 0): "message_bus_unavailable", (8, 0): "message_id_generation_failed", (9, 0): None,
        (10, 0): "message_bus_unavailable", (11, 0): "message_bus_unavailable", (12, 0): None, (13, 0): "message_bus_unavailable",
    }
    assert {r for r in got.values() if r} == {row[0] for row in REASONS}


def test_frames_to_deliveries_through_the_log(spark):
    frames = spark.createDataFrame([frame(c, k, 100 * k + c, room=f"r{c % 2}") for c in range(6) for k in range(4)], FRAME)
    consumers = spark.createDataFrame([(1, 0, 0, "ready")], "event_id long, t_us long, instance_id int, kind string")
    moves = spark.createDataFrame([(1, 150, "r0", "a", "join"), (2, 250, "r0", "a", "leave"), (3, 0, " r1", "b", "join")], "event_id long, t_us long, room_id string, user_id string, kind string")
    out = flow.run(frames, consumers, moves, [0, 1, 2], spread=Spread(width_us=70)).collect()
    heard = sorted((r.room_id, r.sequence, r.member_id, r.t_us) for r in out)
    want = [("r0", n + 1, "a", t) for n, t in enumerate((200, 202, 204))] + [("r1", n + 1, "b", 100 * k + c) for n, (k, c) in enumerate((k, c) for k in range(4) for c in (1, 3, 5))]
    assert heard == sorted(want)
    assert {r.content for r in out} == {"hi"} and all(len(r.message_id) == 32 for r in out)




def test_offsets_have_no_gaps_however_the_log_is_cut(spark):
    rows = spark.range(3000).selectExpr("id", "concat('room-', id % 10) AS room_id", "pmod(id * 7919, 3001) AS t_us")
    for width in (13, 10_000):
        got = bus.with_offsets(rows, [0, 1, 2], ["t_us", "id"], Spread(width_us=width)).groupBy("part").agg(
            F.sort_array(F.collect_list("off")).alias("offs"), F.sort_array(F.collect_list(F.struct("t_us", "id", "off"))).alias("rows")).collect()
        assert sum(len(r.offs) for r in got) == 3000
        for r in got:
            assert r.offs == list(range(len(r.offs))) == [x.off for x in r.rows]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_files_keep_the_order_of_the_log(spark, tmp_path, partitions):
    rows = spark.range(5000).selectExpr("'chat' AS topic", "cast(if(id % 10 < 7, 0, id % 3) AS int) AS part", "pmod(id * 7919, 5000) AS off", "cast('k' AS binary) AS key", "'{}' AS value")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        bus.write_log_files(rows, str(tmp_path / "log"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    found = bus.audit_log_files(spark, str(tmp_path / "log"))
    assert found.agg(F.sum("records"), F.sum("out_of_order")).first()[:] == (5000, 0)
    assert {r.key for r in bus.read_log_files(spark, str(tmp_path / "log")).select("key").distinct().collect()} == {"k"}


def test_the_audit_sees_rows_and_files_out_of_order(spark, tmp_path):
    folder = tmp_path / "topic=chat"
    folder.mkdir()
    for name, offs in (("a.json", [0, 1, 5, 4]), ("b.json", [3, 7]), ("c.json", [7])):
        (folder / name).write_text("".join(json.dumps({"part": 0, "off": o, "key": "k", "value": "{}"}) + "\n" for o in offs))
    assert bus.audit_log_files(spark, str(tmp_path)).first()[:] == (0, 7, 0, 7, 3)
