"""The whole flow composed from the operators: frames in, a written log, numbered deliveries out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream import schema as S
from chatstream.operators import envelope, moderation, publish, ratelimit, rooms
from chatstream.operators.ordered import ALL, HOT, Spread
from chatstream.session import shared_dir, stored
from chatstream.sources import bus


def check_frames(
    frames: DataFrame, dictionary=S.DEFAULT_DICTIONARY, rate=S.DEFAULT_RATE, burst: int = S.DEFAULT_BURST, spread: Spread = HOT,
    consumers: DataFrame | None = None, instants: Spread = ALL,
) -> DataFrame:
    """Frames with their final ``reject_reason``: checks, closed connections, rate limit, publish gate.

    The decoded frames are stored once: finding closed connections, busy users
    and the verdicts read them, and each payload is parsed a single time.

    With the log of ``consumers`` the gate is passed too: frames then say which ``instance_id`` took them, and whether
    making an id or writing to the log failed (``id_failed``, ``write_failed``); ``message_id`` is added.
    """
    moderated = stored(moderation.moderate(frames, dictionary).drop("payload"), "moderated")
    limited = ratelimit.limit_frames(moderation.cut_after_terminal(moderated), rate, burst, spread)
    if consumers is None:
        return limited
    made = envelope.message_id(F.col("conn_id"), F.col("frame_no"), F.col("t_us"))
    gated = publish.with_readiness(limited, consumers, instants).withColumn("message_id", F.when(~F.coalesce("id_failed", F.lit(False)), made))
    written = ~F.coalesce("write_failed", F.lit(False))
    return gated.withColumn(
        "reject_reason", publish.publish_reason(F.col("reject_reason"), F.col("bus_ready"), F.col("message_id"), written)
    ).select(*limited.columns, "message_id")


def write_log(checked: DataFrame, partitions: list[int], path: str, topic: str = "chat", spread: Spread = ALL) -> None:
    """Accepted frames become envelopes in a log: a partition by room, offsets without gaps in the order of their coming."""
    accepted = checked.where(F.col("reject_reason").isNull())
    placed = bus.with_offsets(accepted, partitions, ["t_us", "conn_id", "frame_no"], spread)
    envelopes = envelope.build_envelope(placed, keep=["part", "off"])
    bus.write_log_files(envelope.encode(envelopes, keep=["part", "off"]).withColumn("topic", F.lit(topic)), path)


def read_log(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log records -> (messages, poison). One parse: the decoded records are stored and both tables read them."""
    decoded = stored(envelope.decode(records.select("topic", "part", "off", "value")), "decoded")
    # the sequence in the envelope is that of the sender, always 0; the room gives the real one
    messages = envelope.valid_messages(decoded).drop("sequence").select("*", F.unix_micros("created_at").alias("t_us"), F.col("off").alias("event_id"))
    return messages, envelope.poison_records(decoded)


def run(
    frames: DataFrame, consumers: DataFrame, membership: DataFrame, partitions: list[int], dictionary=S.DEFAULT_DICTIONARY,
    rate=S.DEFAULT_RATE, burst: int = S.DEFAULT_BURST, hot: Spread = HOT, spread: Spread = ALL,
) -> DataFrame:
    """Frames to deliveries, handed over through a log of files as a service hands them over through its broker."""
    spark = frames.sparkSession
    path = shared_dir(spark, "log")
    write_log(check_frames(frames, dictionary, rate, burst, hot, consumers, spread), partitions, path, spread=spread)
    messages, _ = read_log(bus.read_log_files(spark, path))
    intervals = stored(rooms.membership_intervals(membership, hot), "intervals")
    return deliver(messages, intervals, spread)


def broadcast_messages(messages: DataFrame, intervals: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Messages that somebody hears, numbered per room; unheard ones take no number."""
    heard = stored(rooms.heard(messages, intervals, spread).drop("audience"), "heard")
    return rooms.room_sequence(heard)


def deliver(messages: DataFrame, intervals: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Numbered deliveries. ``intervals`` is read several times: give a stored table."""
    return rooms.fanout(broadcast_messages(messages, intervals, spread), intervals, times=messages)
