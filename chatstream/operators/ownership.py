"""Which instance owns a partition at an instant, and what a rebalance does.

The change log holds one row per (change, partition): ``event_id, t_us, part,
instance_id``, with a NULL instance where the assignment was cleared. Every
change raises the revision by one, clears included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatstream.operators.ordered import ALL, Running, Spread, as_of, running


def revisions(log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """One row per change with its running ``revision``."""
    changes = log.groupBy("event_id", "t_us").agg(F.count_if(F.col("instance_id").isNull()).alias("cleared"))
    one = changes.withColumn("_one", F.lit(1).cast("bigint"))
    return running(one, [], "t_us", ["t_us", "event_id"], Running(sums={"revision": "_one"}), spread).drop("_one")


def assigned_partitions(log: DataFrame) -> DataFrame:
    """Sorted partition set of every instance at every change."""
    return (
        log.where(F.col("instance_id").isNotNull())
        .groupBy("event_id", "t_us", "instance_id")
        .agg(F.sort_array(F.collect_set("part")).alias("partitions"))
    )


def with_owner(rows: DataFrame, log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Add ``instance_id`` and ``changed_by``: the owner of the row's ``part`` at its ``t_us``."""
    return as_of(
        rows, log.withColumn("changed_by", F.col("event_id")), ["part"], "t_us",
        ["instance_id", "changed_by"], log_order="event_id", spread=spread,
    )


def with_revision(rows: DataFrame, log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Add the ``revision`` in force at the row's ``t_us`` (0 before the first change)."""
    found = as_of(rows, revisions(log, spread), [], "t_us", ["revision"], log_order="event_id", spread=spread)
    return found.withColumn("revision", F.coalesce("revision", F.lit(0).cast("bigint")))


def rebalance_closed(connections: DataFrame, log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Add ``closed_at`` and ``by_rebalance``: the first change after opening ends a connection,
    even when its partition comes back to the same instance."""
    changes = log.select("event_id", "t_us").distinct().select(
        "t_us", F.lit(0).alias("_kind"), F.col("event_id").alias("_id"), F.col("t_us").alias("_change")
    )
    line = (
        connections.withColumn("t_us", F.col("joined_at")).withColumn("_kind", F.lit(1)).withColumn("_id", F.col("join_id"))
        .unionByName(changes, allowMissingColumns=True)
    )
    seen = running(line, [], "t_us", ["t_us", "_kind", "_id"], Running(next={"_rebalance": "_change"}), spread)
    by_rebalance = F.col("_rebalance").isNotNull() & (F.col("left_at").isNull() | (F.col("_rebalance") < F.col("left_at")))
    return seen.where(F.col("_kind") == 1).select(
        *connections.columns,
        F.least("left_at", "_rebalance").alias("closed_at"),
        by_rebalance.alias("by_rebalance"),
    )


def handshake_recheck(handshakes: DataFrame, log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Handshakes (``event_id, t_us, registered_us``) whose revision moved before registration.

    Both instants go through one as-of pass.
    """
    instants = handshakes.select("event_id", F.lit("before").alias("_at"), "t_us").unionByName(
        handshakes.select("event_id", F.lit("after").alias("_at"), F.col("registered_us").alias("t_us"))
    )
    return (
        with_revision(instants, log, spread)
        .groupBy("event_id")
        .agg(
            F.max(F.when(F.col("_at") == "before", F.col("revision"))).alias("revision_before"),
            F.max(F.when(F.col("_at") == "after", F.col("revision"))).alias("revision_after"),
        )
        .withColumn("accepted", F.col("revision_before").eqNullSafe(F.col("revision_after")))
    )


def assignment_violations(assigned: DataFrame, available: DataFrame) -> DataFrame:
    """Assigned partitions that the topic does not have at that change."""
    return assigned.join(available, ["event_id", "part"], "left_anti")


def ownership_exclusive(claims: DataFrame, available: DataFrame) -> DataFrame:
    """Partitions owned by several instances, or by none, at a change."""
    owners = claims.groupBy("event_id", "part").agg(F.count_distinct("instance_id").alias("owners"))
    return (
        available.join(owners, ["event_id", "part"], "left")
        .withColumn("owners", F.coalesce("owners", F.lit(0).cast("bigint")))
        .where(F.col("owners") != 1)
        .withColumn("problem", F.when(F.col("owners") == 0, "missing").otherwise("duplicate"))
    )


def lease_reconcile(log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Actions per change: register what an instance owns now, release what it no longer owns."""
    seen = running(
        log.withColumn("_owner", F.struct("instance_id")), ["part"], "t_us", ["t_us", "event_id"],
        Running(prev={"_old": "_owner"}), spread,
    )
    actions = F.array(
        F.struct(F.col("instance_id"), F.lit("register").alias("action")),
        F.struct(F.col("_old.instance_id"), F.lit("release").alias("action")),
    )
    return (
        seen.withColumn("_a", F.explode(actions))
        .where(F.col("_a.instance_id").isNotNull())
        .where((F.col("_a.action") == "register") | ~F.col("_a.instance_id").eqNullSafe(F.col("instance_id")))
        .select("event_id", "t_us", "part", F.col("_a.instance_id").alias("instance_id"), F.col("_a.action").alias("action"))
    )
