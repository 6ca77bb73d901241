"""Delivery audit: the sender's own echoes, duplicates, latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatstream.schema import ECHO_PREFIX

_DIGIT_BITS = 21


def parse_echo(received: DataFrame, prefix: str = ECHO_PREFIX) -> DataFrame:
    """Received rows that are the reader's own echo, with ``sent_ns`` and ``latency_ns``.

    Content is ``prefix:user:nanoseconds``, exactly three parts; all else is skipped.
    """
    parts = F.split("content", ":", -1)
    number = F.get(parts, F.lit(2))
    sent = F.when(number.rlike("^[+-]?[0-9]+$"), number.try_cast("bigint"))
    return (
        received.where(
            (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == prefix) & (F.get(parts, F.lit(1)) == F.col("user_id"))
        )
        .withColumn("sent_ns", sent)
        .where(F.col("sent_ns").isNotNull())
        .withColumn("latency_ns", F.col("received_ns") - F.col("sent_ns"))
    )


def first_echo(received: DataFrame, prefix: str = ECHO_PREFIX) -> DataFrame:
    """One row per echoed message: latency of the first arrival and the number of copies.

    A plain aggregate, combined before the shuffle, so one message with very
    many copies costs one row per task.
    """
    return (
        parse_echo(received, prefix)
        .groupBy("user_id", "content", "sent_ns")
        .agg(F.min("received_ns").alias("first_ns"), F.count(F.lit(1)).alias("copies"))
        .withColumn("latency_ns", F.col("first_ns") - F.col("sent_ns"))
    )


def sent_delivery(sent: DataFrame, received: DataFrame, prefix: str = ECHO_PREFIX) -> DataFrame:
    """Every sent message with its echo, if any. Copies are folded before the join."""
    echoes = first_echo(received, prefix).select("user_id", "content", "copies", "latency_ns")
    return sent.join(echoes, ["user_id", "content"], "left").withColumn(
        "copies", F.coalesce("copies", F.lit(0).cast("bigint"))
    )


def delivery_report(sent: DataFrame, received: DataFrame, errors: DataFrame | None = None, prefix: str = ECHO_PREFIX) -> DataFrame:
    """One row: sent, received, own deliveries, duplicates, rate, errors, largest latency."""
    per_message = first_echo(received, prefix)
    parts = [
        sent.agg(F.count(F.lit(1)).alias("sent")),
        received.agg(F.count(F.lit(1)).alias("received")),
        per_message.agg(
            F.count(F.lit(1)).alias("self_delivered"),
            (F.coalesce(F.sum("copies"), F.lit(0)) - F.count(F.lit(1))).alias("duplicates"),
            F.max("latency_ns").alias("max_latency_ns"),
        ),
    ]
    if errors is not None:
        parts.append(
            errors.agg(
                F.count_if(F.col("kind") == "write").alias("write_errors"),
                F.count_if(F.col("kind") == "read").alias("read_errors"),
            )
        )
    # Each part is one row; they are stacked and folded, not joined.
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    columns = [c for part in parts for c in part.columns]
    rate = F.when(F.col("sent") > 0, F.col("self_delivered") / F.col("sent") * 100).otherwise(F.lit(0.0))
    return stacked.agg(*[F.max(c).alias(c) for c in columns]).withColumn("delivery_rate", rate)


def floor_percentiles(df: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """Exact ``sorted[(n - 1) * p / 100]`` of a BIGINT column, per group.

    Nothing is sorted as a whole: the rank is narrowed down 21 bits at a time, so
    each step sums at most 2^22 counts per group whatever the number of rows.
    Without groups each step counts digits straight from the rows, before any
    shuffle, and the rows that go on are found by a filter on the digits so far
    (a row for each percentile). With groups equal values are counted first.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull())
    if by:
        counts = rows.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = rows.select(F.col(value).alias("_v"), F.lit(1).cast("bigint").alias("_n"))
    mask = (1 << _DIGIT_BITS) - 1
    digits = {
        "_d0": F.shiftright("_v", 2 * _DIGIT_BITS),
        "_d1": F.shiftright("_v", _DIGIT_BITS).bitwiseAND(F.lit(mask)),
        "_d2": F.col("_v").bitwiseAND(F.lit(mask)),
    }
    counts = counts.select("*", *[c.alias(n) for n, c in digits.items()])

    # First digit: the ranks asked for follow from the total.
    buckets = counts.groupBy(*by, "_d0").agg(F.sum("_n").alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_d0")
    everything = Window.partitionBy(*by)
    wanted = F.array(
        *[
            F.struct(F.lit(p).alias("percent"), F.expr(f"((_total - 1) * {p}) div 100").alias("rank"))
            for p in percents
        ]
    )
    hit = (
        buckets.withColumn("_cum", F.sum("_n").over(up_to))
        .withColumn("_total", F.sum("_n").over(everything))
        .withColumn("_w", F.explode(wanted))
        .select(*by, "_d0", "_n", "_cum", "_w.percent", F.col("_w.rank").alias("_rank"))
        .where((F.col("_rank") >= F.col("_cum") - F.col("_n")) & (F.col("_rank") < F.col("_cum")))
        .select(*by, "_d0", "percent", (F.col("_rank") - F.col("_cum") + F.col("_n")).alias("_rank"))
    )
    known = ["_d0"]
    for digit in ["_d1", "_d2"]:
        scope = [*by, "percent", "_rank", *known]
        inside = counts.join(hit if by else F.broadcast(hit), [*by, *known]).groupBy(*scope, digit).agg(F.sum("_n").alias("_n"))
        up_to = Window.partitionBy(*scope).orderBy(digit)
        hit = (
            inside.withColumn("_cum", F.sum("_n").over(up_to))
            .where((F.col("_rank") >= F.col("_cum") - F.col("_n")) & (F.col("_rank") < F.col("_cum")))
            .withColumn("_rank", F.col("_rank") - F.col("_cum") + F.col("_n"))
            .drop("_n", "_cum")
        )
        known.append(digit)
    whole = F.expr(f"shiftleft(_d0, {2 * _DIGIT_BITS}) | shiftleft(_d1, {_DIGIT_BITS}) | _d2")
    return hit.select(*by, "percent", whole.alias(value))
