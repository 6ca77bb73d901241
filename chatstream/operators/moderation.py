"""Admission of client frames: the ordered checks, their effect on the connection, replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream import schema as S
from chatstream.functions import strict_json as J
from chatstream.functions.pinning import pinned
from chatstream.functions.text import first_match, is_blank, trim_space


def moderate(
    frames: DataFrame,
    dictionary: list[str] = S.DEFAULT_DICTIONARY,
    max_bytes: int = S.MAX_FRAME_BYTES,
    max_chars: int = S.MAX_CONTENT_CHARS,
) -> DataFrame:
    """Add ``content``, ``matched_word`` and ``reject_reason`` (NULL when accepted).

    The checks are one CASE, so the first failing check names the reason.
    Frames over the size limit are not parsed at all. In a binary payload bytes
    that are not UTF-8 are replaced before decoding.
    """
    text = F.col("payload")
    if dict(frames.dtypes)["payload"] == "binary":
        text = F.make_valid_utf8(text.cast("string"))
    fits = F.when(F.octet_length("payload") <= max_bytes, text)
    parsed = (
        J.with_parsed(frames.withColumn("_text", fits), "_text", ["content"])
        .withColumn("_decodes", pinned(J.shape_ok() & J.field_types_ok("_text", "content", ["STRING"])))
        .withColumn("content", pinned(F.when(F.col("_decodes"), J.string_field("_text", "content"))))
        .withColumn("matched_word", first_match(F.col("content"), dictionary))
    )
    reason = (
        F.when(F.octet_length("payload") > max_bytes, "frame_too_large")
        .when(~F.col("_decodes"), "invalid_json")
        .when(is_blank(F.col("content")), "empty_content")
        .when(F.char_length("content") > max_chars, "content_too_long")
        .when(F.col("matched_word").isNotNull(), "sensitive_content")
    )
    return (
        parsed.withColumn("reject_reason", pinned(reason))
        .withColumn("matched_word", F.when(F.col("reject_reason") == "sensitive_content", F.col("matched_word")))
        .drop(*J.PARSED, "_decodes", "_text")
    )


def cut_after_terminal(moderated: DataFrame) -> DataFrame:
    """Drop the frames of a connection that come after the one that closed it.

    The closing frame per connection is a map-side-combined minimum. The frames
    join it by connection, which adaptive execution splits when one is hot.
    """
    closing = (
        moderated.where(F.col("reject_reason").isin(S.TERMINAL_REASONS))
        .groupBy("conn_id")
        .agg(F.min("frame_no").alias("_closed_by"))
    )
    return (
        moderated.join(closing, "conn_id", "left")
        .where(F.col("_closed_by").isNull() | (F.col("frame_no") <= F.col("_closed_by")))
        .drop("_closed_by")
    )


def reason_dimension(spark) -> DataFrame:
    return spark.createDataFrame(S.REASONS, "reject_reason string, code string, message string, action string")


def protocol_errors(moderated: DataFrame) -> DataFrame:
    """Wire reply and connection action of every rejected frame (eight-row dimension)."""
    rejected = moderated.where(F.col("reject_reason").isNotNull())
    return rejected.join(F.broadcast(reason_dimension(moderated.sparkSession)), "reject_reason", "left")


def handshake_reason(ready, user_id, room_id, owned):
    """First failing handshake check; NULL when the connection may open."""
    return (
        F.when(~F.coalesce(ready, F.lit(False)), "not_ready")
        .when(is_blank(user_id), "missing_user_id")
        .when(is_blank(room_id), "missing_room_id")
        .when(~F.coalesce(owned, F.lit(False)), "room_not_owned")
    )


def check_handshakes(attempts: DataFrame) -> DataFrame:
    """Attempts with ``ready, user_id, room_id, owned`` -> trimmed ids and ``reject_reason``."""
    return (
        attempts.withColumn("reject_reason", handshake_reason(F.col("ready"), F.col("user_id"), F.col("room_id"), F.col("owned")))
        .withColumn("user_id", trim_space(F.col("user_id")))
        .withColumn("room_id", trim_space(F.col("room_id")))
    )
