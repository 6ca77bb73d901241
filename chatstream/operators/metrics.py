"""Counters, gauges and histograms as rows ``(metric, labels, value)``, and their text form.

Labels come from bounded sets only; rooms and users are never labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.operators.ordered import ALL, HOT, Running, Spread, running
from chatstream.schema import LATENCY_BUCKETS, PONG_TIMEOUT_US

NAMESPACE = "chatstream"
_EXACT = "decimal(38,9)"


def rejections_by_reason(checked: DataFrame) -> DataFrame:
    """Rejected frames per reason; only reasons that occur."""
    return (
        checked.where(F.col("reject_reason").isNotNull())
        .groupBy(F.col("reject_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("rejected"))
    )


def frame_counters(checked: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Received and rejected totals from one aggregate of at most nine rows."""
    per_reason = checked.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))
    received = per_reason.agg(
        F.coalesce(F.sum(F.when(~F.col("reject_reason").eqNullSafe(F.lit("frame_too_large")), F.col("n"))), F.lit(0)).alias("n")
    )
    return received.select(
        F.lit(f"{namespace}_messages_received_total").alias("metric"), F.lit("").alias("labels"), F.col("n").cast(_EXACT).alias("value")
    ).unionByName(
        per_reason.where(F.col("reject_reason").isNotNull()).select(
            F.lit(f"{namespace}_messages_rejected_total").alias("metric"),
            F.format_string('reason="%s"', "reject_reason").alias("labels"),
            F.col("n").cast(_EXACT).alias("value"),
        )
    )


def bucket_counts(seconds: str, bounds: list[str] = LATENCY_BUCKETS) -> list[Column]:
    """Aggregates ``le_0 ... le_k, n, total``: cumulative buckets (bound inclusive), count and sum.

    The sum is kept in exact decimals, so it does not depend on how rows are split.
    """
    v = F.col(seconds)
    return [
        *[F.count_if(v <= F.lit(float(b))).alias(f"le_{i}") for i, b in enumerate(bounds)],
        F.count(v).alias("n"),
        F.coalesce(F.sum(v.cast("decimal(28,9)")), F.lit(0)).cast(_EXACT).alias("total"),
    ]


def latency_histogram(timings: DataFrame, seconds: str, metric: str, bounds: list[str] = LATENCY_BUCKETS) -> DataFrame:
    """Histogram samples from one pass over the timings."""

    def row(name: str, labels: str, value: str) -> Column:
        return F.struct(F.lit(f"{metric}_{name}").alias("metric"), F.lit(labels).alias("labels"), F.col(value).cast(_EXACT).alias("value"))

    rows = [row("bucket", f'le="{b}"', f"le_{i}") for i, b in enumerate(bounds)]
    rows += [row("bucket", 'le="+Inf"', "n"), row("sum", "", "total"), row("count", "", "n")]
    return timings.agg(*bucket_counts(seconds, bounds)).select(F.inline(F.array(*rows)))


def samples(df: DataFrame, values: dict[str, str], label: str | None = None, namespace: str = NAMESPACE) -> DataFrame:
    """Gauges and counters from columns: metric name -> column, labelled by a column of bounded values."""
    labels = F.lit("") if label is None else F.concat(F.lit(f'{label}="'), F.col(label).cast("string"), F.lit('"'))
    rows = [
        F.struct(F.lit(f"{namespace}_{name}").alias("metric"), labels.alias("labels"), F.col(column).cast(_EXACT).alias("value"))
        for name, column in values.items()
    ]
    return df.select(F.inline(F.array(*rows)))


def metrics_lines(samples: DataFrame) -> DataFrame:
    """One exposition line per sample: ``name{labels} value``."""
    number = F.regexp_replace(F.col("value").cast(_EXACT).cast("string"), r"\.?0+$", "")
    labels = F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(F.lit(""))
    return samples.select(F.concat("metric", labels, F.lit(" "), number).alias("line"))


def connections_gauge(changes: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Open connections after every change, over the whole system."""
    return running(changes, [], "t_us", ["t_us", "event_id"], Running(sums={"connections": "delta"}), spread)


def connections_peak(changes: DataFrame, spread: Spread = ALL) -> DataFrame:
    return connections_gauge(changes, spread).agg(
        F.max("connections").alias("peak"), F.sum("delta").alias("current"), F.count_if(F.col("delta") > 0).alias("opened")
    )


def connection_durations(intervals: DataFrame) -> DataFrame:
    closed = intervals.where(F.col("left_at").isNotNull())
    return closed.select("room_id", "user_id", "join_id", (F.col("left_at") - F.col("joined_at")).alias("duration_us"))


def consumer_state(log: DataFrame) -> DataFrame:
    """Per instance: is it running, is it ready, how often did it restart."""
    def latest(on: list[str], off: list[str]):
        state = F.when(F.col("kind").isin(*on), 1).when(F.col("kind").isin(*off), 0)
        return F.coalesce(F.max_by(state, F.when(state.isNotNull(), F.struct("t_us", "event_id"))), F.lit(0))

    return log.groupBy("instance_id").agg(
        latest(["running"], ["stopped"]).alias("running"),
        latest(["ready"], ["not_ready", "restart", "stopped"]).alias("ready"),
        F.count_if(F.col("kind") == "restart").alias("restarts"),
    )


def access_log(rows: DataFrame) -> DataFrame:
    """Request rows without query string, with the log level that their status asks for."""
    level = F.when(F.col("status") >= 500, "error").when(F.col("status") >= 400, "warn").otherwise("info")
    return rows.withColumn("path", F.substring_index("path", "?", 1)).withColumn("level", level)


def access_summary(rows: DataFrame) -> DataFrame:
    return (
        access_log(rows)
        .groupBy("level", "method", "path", "status")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.sum(F.col("latency_ms").cast("decimal(18,3)")).cast("double").alias("latency_ms"),
            F.max("latency_ms").alias("max_latency_ms"),
        )
    )


def liveness_timeouts(
    pongs: DataFrame, timeout_us: int = PONG_TIMEOUT_US, until_us: int | None = None, spread: Spread = HOT
) -> DataFrame:
    """Silences longer than the timeout: the last sign of life and when the connection was given up.

    The silence after a connection's very last sign is reported when ``until_us``,
    the instant up to which the log is complete, is given.
    """
    seen = running(pongs, ["conn_id"], "t_us", ["t_us", "event_id"], Running(next={"_heard": "t_us"}), spread)
    heard = F.col("_heard") if until_us is None else F.coalesce("_heard", F.lit(until_us))
    return seen.where(heard - F.col("t_us") > timeout_us).select(
        "conn_id", "event_id", F.col("t_us").alias("last_us"), (F.col("t_us") + timeout_us).alias("timed_out_us")
    )
