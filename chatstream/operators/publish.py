"""The last gate before the log: is the consumer ready, is there an id, did the write succeed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.operators.ordered import ALL, Spread, as_of


def with_readiness(rows: DataFrame, consumer_log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Add ``bus_ready``: was the row's ``instance_id`` ready to consume at its ``t_us``."""
    ready = F.when(F.col("kind") == "ready", True).when(F.col("kind").isin("not_ready", "restart", "stopped"), False)
    changes = consumer_log.withColumn("bus_ready", ready).where(F.col("bus_ready").isNotNull())
    found = as_of(rows, changes, ["instance_id"], "t_us", ["bus_ready"], log_order="event_id", spread=spread)
    return found.withColumn("bus_ready", F.coalesce("bus_ready", F.lit(False)))


def publish_reason(reason: Column, ready: Column, message_id: Column, published: Column | None = None) -> Column:
    """The reason so far, or why the message did not reach the log.

    The limiter comes first: a message held back here has used its token.
    """
    failed = F.lit(False) if published is None else ~F.coalesce(published, F.lit(False))
    return (
        F.when(reason.isNotNull(), reason)
        .when(~F.coalesce(ready, F.lit(False)), "message_bus_unavailable")
        .when(F.coalesce(message_id, F.lit("")) == "", "message_id_generation_failed")
        .when(failed, "message_bus_unavailable")
    )
