"""Partition leases: keys, and lookups as of an instant.

The lease log holds ``event_id, t_us, part, kind, gateway_id, websocket_url,
token, ttl_us``. A register replaces whatever was there; a release counts only
with the token of the lease in force; a lease ends after its time to live.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.functions.hashing import partition_for_room
from chatstream.functions.text import is_blank, trim_space
from chatstream.functions.urls import valid_lease
from chatstream.operators.ordered import ALL, HOT, Running, Spread, running

DEFAULT_PREFIX = "chatstream:routing"


def lease_key(prefix: Column, topic: Column, group: Column, part: Column, default: str = DEFAULT_PREFIX) -> Column:
    """``prefix:topic:group:partition:n``; one trailing colon of the prefix is dropped."""
    base = F.regexp_replace(trim_space(F.coalesce(prefix, F.lit(""))), ":$", "")
    base = F.when(base == "", F.lit(default)).otherwise(base)
    scoped = F.regexp_replace(trim_space(F.format_string("%s:%s:%s", base, topic, group)), ":$", "")
    return F.format_string("%s:partition:%d", scoped, part)


def acceptable() -> Column:
    """Is a register or release complete; other operations are."""
    register = valid_lease(F.col("gateway_id"), F.col("websocket_url"), F.col("token")) & (F.col("ttl_us") > 0)
    return F.when(F.col("kind") == "register", register).when(F.col("kind") == "release", ~is_blank(F.col("token"))).otherwise(True)


def usable(log: DataFrame) -> DataFrame:
    """Registers and releases that are accepted at all."""
    return log.where(F.col("kind").isin("register", "release") & (F.col("part") >= 0) & acceptable())


def leases(log: DataFrame, spread: Spread = HOT) -> DataFrame:
    """Registered leases with the first later release that carries their own token.

    A release that comes after another register of the partition is found here
    too, but by then that other lease is the one in force, so it has no effect.
    """
    line = usable(log).withColumn("_release", F.when(F.col("kind") == "release", F.struct("t_us", "event_id")))
    seen = running(line, ["part", "token"], "t_us", ["t_us", "event_id"], Running(next={"released": "_release"}), spread)
    return seen.where(F.col("kind") == "register").drop("_release", "kind")


def route_lookup(probes: DataFrame, log: DataFrame, spread: Spread = ALL) -> DataFrame:
    """For each probe (``event_id, t_us, part``) the route as of its instant.

    ``status`` is live, released, expired or never; the address is given only
    while live, and the token never leaves.
    """
    found = leases(log, replace(spread, mode="hot")).select(
        "part", "t_us", "event_id",
        F.struct("t_us", "event_id", "ttl_us", "gateway_id", "websocket_url", "released").alias("_lease"),
    )
    line = probes.withColumn("_probe", F.lit(True)).unionByName(found, allowMissingColumns=True)
    seen = running(line, ["part"], "t_us", ["t_us", "event_id"], Running(last={"_current": "_lease"}), spread)
    ends = F.col("_current.t_us") + F.col("_current.ttl_us")
    released = F.col("_current.released").isNotNull() & (F.col("_current.released") < F.struct("t_us", "event_id"))
    status = (
        F.when(F.col("_current").isNull(), "never")
        .when(released & (F.col("_current.released.t_us") < ends), "released")
        .when(F.col("t_us") >= ends, "expired")
        .otherwise("live")
    )
    live = F.col("status") == "live"
    return (
        seen.where(F.col("_probe"))
        .withColumn("status", status)
        .select(
            *probes.columns,
            "status",
            F.when(live, F.col("_current.gateway_id")).alias("gateway_id"),
            F.when(live, F.col("_current.websocket_url")).alias("websocket_url"),
        )
    )


def route_requests(requests: DataFrame, log: DataFrame, partitions: list[int], spread: Spread = ALL) -> DataFrame:
    """Route of a room as of each request (``event_id, t_us, room_id``): room to partition to lease.

    ``http_status`` is 400 for a blank room, 503 while its partition has no live lease, else 200; only then the answer
    names partition and address. The token never leaves.
    """
    room = trim_space(F.coalesce("room_id", F.lit("")))
    asked = requests.select("event_id", "t_us", room.alias("room_id")).withColumn("part", partition_for_room(F.col("room_id"), partitions))
    found = route_lookup(asked, log, spread)
    code = F.when(F.col("room_id") == "", 400).when(F.col("part").isNull() | (F.col("status") != "live"), 503).otherwise(200)
    given = F.col("http_status") == 200
    return found.withColumn("http_status", code).select(
        "event_id", "t_us", "room_id", "http_status", *[F.when(given, F.col(c)).alias(n) for c, n in (("part", "partition"), ("gateway_id", "gateway_id"), ("websocket_url", "websocket_url"))]
    )
