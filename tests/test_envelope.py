import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatstream.operators import envelope
from chatstream.sources import bus
from chatstream.sources.frames import read_access_log, read_frames, write_metrics

GOOD = '"message_id":"m","room_id":"r","user_id":"u","content":"c","created_at":"2024-01-01T00:00:00.5Z"'
VALUES = [
    ("{%s}" % GOOD, None, None), ("{%s,\"sequence\":18446744073709551615}" % GOOD, None, None), ("{%s,\"sequence\":null}" % GOOD, None, None),
    ("{%s,\"Room_ID\":\"x\"}" % GOOD, None, None), ("{%s,\"extra\":[1,{}]}" % GOOD, None, None),
    ("{%s,\"uſer_id\":\"x\"}" % GOOD, None, None),
    ("not-json", "malformed", None), ('{"message_id":1}', "malformed", None), ("{%s} x" % GOOD, "malformed", None),
    ("{%s,\"room_id\":5}" % GOOD, "malformed", None), ("", "malformed", None), ("[]", "malformed", None),
    *[("{%s,\"sequence\":%s}" % (GOOD, bad), "malformed", None) for bad in ["-1", "18446744073709551616", "1.0", "1e0", "1.5", '"7"', "true"]],
    *[(("{%s}" % GOOD).replace("2024-01-01T00:00:00.5Z", bad), "malformed", None)
      for bad in ["yesterday", "2024-01-01", "2024-01-01 00:00:00Z", "2024-02-30T00:00:00Z", "2024-01-01T24:00:00Z"]],
    ("null", "invalid", "empty_message_id"), ("{}", "invalid", "empty_message_id"),
    ('{"message_id":"m","user_id":"u"}', "invalid", "empty_room_id"),
    ('{"message_id":"m","room_id":"r","content":"c"}', "invalid", "empty_user_id"),
    ('{"message_id":"m","room_id":"r","user_id":"u","content":"\\t"}', "invalid", "empty_content"),
    ('{"message_id":"m","room_id":"r","user_id":"u","content":"c"}', "invalid", "empty_created_at"),
    (("{%s}" % GOOD).replace("2024-01-01T00:00:00.5Z", "0001-01-01T00:00:00Z"), "invalid", "empty_created_at"),
    (("{%s}" % GOOD).replace('"2024-01-01T00:00:00.5Z"', "null"), "invalid", "empty_created_at"),
]


@pytest.fixture(scope="module")
def decoded(spark):
    df = spark.createDataFrame([("t", 0, i, v) for i, (v, _, _) in enumerate(VALUES)], "topic string, part int, off long, value string")
    return {r.off: r for r in envelope.decode(df).collect()}


@pytest.mark.parametrize("i", range(len(VALUES)))
def test_poison_classes(decoded, i):
    assert (decoded[i].error_class, decoded[i].invalid_code) == VALUES[i][1:], VALUES[i][0]


def test_decoded_values(decoded):
    assert int(decoded[1].sequence) == 2**64 - 1 and int(decoded[0].sequence) == 0
    assert decoded[3].room_id == "x" and decoded[5].user_id == "x"
    assert decoded[0].created_at == dt.datetime(2024, 1, 1, 0, 0, 0, 500000)


def test_bytes_that_are_not_utf8_are_replaced(spark):
    value = b'{"message_id":"m\xff","room_id":"r","user_id":"u","content":"c","created_at":"2024-01-01T00:00:00+01:00"}'
    df = spark.createDataFrame([("t", 0, 1, bytearray(value))], "topic string, part int, off long, value binary")
    row = envelope.decode(df).first()
    assert row.error_class is None and row.message_id == "m�"
    assert row.created_at == dt.datetime(2023, 12, 31, 23, 0)


def test_validation_order(spark):
    now = dt.datetime(2024, 1, 1)
    data = [(" ", "", "", "", None), ("m", "\t", "", "", None), ("m", "r", None, "", None), ("m", "r", "u", "　", None), ("m", "r", "u", "c", None), ("m", "r", "u", "c", now)]
    df = spark.createDataFrame(data, "message_id string, room_id string, user_id string, content string, created_at timestamp")
    assert [r.invalid_code for r in envelope.validate(df).collect()] == [
        "empty_message_id", "empty_room_id", "empty_user_id", "empty_content", "empty_created_at", None]


def test_message_ids(spark):
    frames = spark.range(1000).select(F.col("id").alias("conn_id"), F.lit(0).alias("frame_no"), F.lit(5).alias("t_us"))
    ids = [r[0] for r in frames.select(envelope.message_id(F.col("conn_id"), F.col("frame_no"), F.col("t_us"))).collect()]
    again = [r[0] for r in frames.select(envelope.message_id(F.col("conn_id"), F.col("frame_no"), F.col("t_us"))).collect()]
    assert len(set(ids)) == 1000 and ids == again and all(len(i) == 32 and i == i.lower() for i in ids)
    assert len(spark.range(1).select(envelope.random_message_id()).first()[0]) == 32


def test_encode_decode_round_trip(spark, rows):
    data = [(f"m{i}", "房间", "u", 'q"\\\n', i, dt.datetime(2024, 1, 1, 0, 0, 10, i * 100000)) for i in range(3)]
    schema = "message_id string, room_id string, user_id string, content string, sequence decimal(20,0), created_at timestamp"
    df = spark.createDataFrame([(*d[:4], __import__("decimal").Decimal(d[4]), d[5]) for d in data], schema)
    encoded = envelope.encode(df)
    assert {r.key.decode() for r in encoded.collect()} == {"房间"}
    assert '"created_at":"2024-01-01T00:00:10Z"' in encoded.orderBy("value").first().value.decode()
    records = encoded.select(F.lit("t").alias("topic"), F.lit(0).alias("part"), F.lit(0).alias("off"), "value")
    back = envelope.valid_messages(envelope.decode(records)).select(*envelope.FIELDS)
    assert rows(back) == rows(df)


@pytest.mark.parametrize("brokers, topic, group", [([], "t", "g"), (["a", " "], "t", "g"), (["a"], "", "g"), (["a"], "t", "")])
def test_log_configuration_errors(brokers, topic, group):
    with pytest.raises(ValueError):
        bus.kafka_options(brokers, topic, group)


def test_log_files_round_trip(spark, rows, tmp_path):
    data = [("t", p, o, "room", f"v{o}") for p in range(3) for o in range(5)]
    df = spark.createDataFrame(data, "topic string, part int, off long, key string, value string")
    bus.write_log_files(df, str(tmp_path / "log"))
    back = bus.read_log_files(spark, str(tmp_path / "log")).select(df.columns)
    assert rows(back) == rows(df)


def test_frame_and_access_files(spark, tmp_path):
    (tmp_path / "frames").mkdir()
    (tmp_path / "frames" / "a.json").write_text('{"conn_id":1,"frame_no":0,"room_id":"r","user_id":"u","t_us":5,"payload":"{}"}\n')
    assert read_frames(spark, str(tmp_path / "frames")).first().payload == "{}"
    (tmp_path / "access").mkdir()
    (tmp_path / "access" / "a.json").write_text('{"t_us":5,"method":"GET","path":"/ws?x=1","status":101,"latency_ms":0.5,"client_ip":"::1"}\n')
    assert read_access_log(spark, str(tmp_path / "access")).first().status == 101
    write_metrics(spark.createDataFrame([("a 1",), ("b 2",)], "line string"), str(tmp_path / "metrics"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "metrics")).collect()) == ["a 1", "b 2"]
