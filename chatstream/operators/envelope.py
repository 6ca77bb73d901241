"""Message envelopes: build, validate, encode for the log, decode from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.functions import strict_json as J
from chatstream.functions.pinning import pinned
from chatstream.functions.text import is_blank

FIELDS = ["message_id", "room_id", "user_id", "content", "sequence", "created_at"]
_REQUIRED_TEXT = ["message_id", "room_id", "user_id", "content"]


def message_id(*parts: Column) -> Column:
    """128-bit id as 32 hex digits, the same again when a task is retried."""
    return F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))


def random_message_id() -> Column:
    """Random id; only for a result that is written before it is read twice."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def build_envelope(accepted: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Accepted frames -> publishable envelopes, stamped with their ingress time; columns to ``keep`` stay beside them."""
    return accepted.select(
        *(keep or []),
        message_id(F.col("conn_id"), F.col("frame_no"), F.col("t_us")).alias("message_id"),
        "room_id",
        "user_id",
        "content",
        F.lit(0).cast("decimal(20,0)").alias("sequence"),
        F.timestamp_micros("t_us").alias("created_at"),
    )


def invalid_code() -> Column:
    """First missing required field; NULL for a valid envelope. Sequence 0 is legal."""
    code = F.when(is_blank(F.col(_REQUIRED_TEXT[0])), f"empty_{_REQUIRED_TEXT[0]}")
    for name in _REQUIRED_TEXT[1:]:
        code = code.when(is_blank(F.col(name)), f"empty_{name}")
    return code.when(F.col("created_at").isNull(), "empty_created_at")


def validate(envelopes: DataFrame) -> DataFrame:
    return envelopes.withColumn("invalid_code", invalid_code())


def rfc3339(ts: Column) -> Column:
    """UTC instant with as many fraction digits as needed."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def encode(envelopes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Envelope -> log record: key is the room, value the JSON text; columns to ``keep`` stay beside them."""
    value = F.to_json(F.struct(*FIELDS[:4], "sequence", rfc3339(F.col("created_at")).alias("created_at")))
    return envelopes.select(*(keep or []), F.col("room_id").cast("binary").alias("key"), value.cast("binary").alias("value"))


def decode(records: DataFrame) -> DataFrame:
    """Log records -> envelope fields plus ``error_class`` and ``invalid_code``.

    ``malformed`` is text that does not decode into the field types, ``invalid``
    decodes but lacks a required field. Bytes that are not UTF-8 are replaced
    before decoding. Both kinds are data: nothing is raised and the flow goes on.
    """
    if dict(records.dtypes)["value"] == "binary":
        records = records.withColumn("value", F.make_valid_utf8(F.col("value").cast("string")))
    parsed = J.with_parsed(records, "value", FIELDS)
    sequence_ok, sequence = J.uint64_field("value", "sequence")
    strings_ok = J.shape_ok()
    for name in [*_REQUIRED_TEXT, "created_at"]:
        strings_ok = strings_ok & J.field_types_ok("value", name, ["STRING"])
    created_ok = F.col("_created").isNull() | F.col("_at").isNotNull()
    typed = (
        parsed.withColumn("_strings_ok", pinned(strings_ok))
        .withColumn("_created", pinned(F.when(F.col("_strings_ok"), J.string_field("value", "created_at"))))
        .withColumn("_at", pinned(J.instant(F.col("_created"))))
        .withColumn("_ok", pinned(F.col("_strings_ok") & sequence_ok & created_ok))
    )
    read = typed.select(
        *records.columns,
        "_ok",
        *[pinned(F.when(F.col("_ok"), J.string_field("value", name))).alias(name) for name in _REQUIRED_TEXT],
        pinned(F.when(F.col("_ok"), sequence)).alias("sequence"),
        pinned(F.when(F.col("_ok"), J.unless_zero(F.col("_at")))).alias("created_at"),
    )
    code = F.when(F.col("_ok"), invalid_code())
    return (
        read.withColumn("invalid_code", pinned(code))
        .withColumn("error_class", F.when(~F.col("_ok"), "malformed").when(F.col("invalid_code").isNotNull(), "invalid"))
        .drop("_ok")
    )


def valid_messages(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error_class").isNull()).drop("error_class", "invalid_code", "value")


def poison_records(decoded: DataFrame) -> DataFrame:
    """Evidence of every skipped record: where it was and what was wrong."""
    return decoded.where(F.col("error_class").isNotNull()).select(
        "topic", "part", "off", "error_class", "invalid_code",
        F.when(F.col("error_class") == "invalid", F.coalesce("message_id", F.lit(""))).alias("message_id"),
        F.when(F.col("error_class") == "invalid", F.coalesce("room_id", F.lit(""))).alias("room_id"),
    )
