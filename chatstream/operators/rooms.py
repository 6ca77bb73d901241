"""Rooms: membership intervals, audience, message numbering, fan-out and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.functions.text import is_blank, trim_space
from chatstream.operators.ordered import ALL, HOT, Running, Spread, floor_div, running
from chatstream.schema import HOUR_US

#: Log positions per slice when messages of a room are numbered.
OFFSETS_PER_SLICE = 1_000_000
#: Slices in a stretch, by which stays are laid out first; stretches lie in longer ones, up to the first of at least a day.
STRETCH = 64
DAY_US = 24 * HOUR_US
#: Receipts of a message that one delivery is compared with, about.
RECEIPTS = 64
#: Messages of a room's slice that meet its stays in one task, about.
MESSAGES = 4096


def membership_history(log: DataFrame, spread: Spread = HOT) -> DataFrame:
    """Join/leave log -> every row with ``outcome``: accepted, or why it was refused.

    A join counts only while absent and a leave only while present, so the state
    before a row is simply the kind of the row before it.
    """
    trimmed = log.withColumn("room_id", trim_space(F.col("room_id")))
    blank = (
        F.when(is_blank(F.col("room_id")), "empty_room_id")
        .when((F.col("kind") == "join") & is_blank(F.col("user_id")), "empty_client_id")
        .when(is_blank(F.col("user_id")), "client_not_found")
    )
    checked = trimmed.withColumn("_blank", blank)
    line = checked.where(F.col("_blank").isNull()).withColumn(
        "_leave", F.when(F.col("kind") == "leave", F.struct("t_us", "event_id"))
    )
    seen = running(
        line, ["room_id", "user_id"], "t_us", ["t_us", "event_id"],
        Running(prev={"_before": "kind"}, next={"_left": "_leave"}), spread,
    )
    present = F.coalesce(F.col("_before") == "join", F.lit(False))
    outcome = (
        F.when((F.col("kind") == "join") & present, "already_joined")
        .when((F.col("kind") == "leave") & ~present, "client_not_found")
        .otherwise("accepted")
    )
    refused = checked.where(F.col("_blank").isNotNull()).select(*log.columns, F.col("_blank").alias("outcome"))
    return seen.select(*log.columns, outcome.alias("outcome"), "_left").unionByName(refused, allowMissingColumns=True)


def membership_intervals(log: DataFrame, spread: Spread = HOT) -> DataFrame:
    """Stays: ``joined_at <= t < left_at``; ``left_at`` is NULL while the client is there."""
    history = membership_history(log, spread)
    return history.where((F.col("kind") == "join") & (F.col("outcome") == "accepted")).select(
        "room_id",
        "user_id",
        F.col("t_us").alias("joined_at"),
        F.col("event_id").alias("join_id"),
        F.col("_left.t_us").alias("left_at"),
        F.col("_left.event_id").alias("leave_id"),
    )


def membership_rejects(log: DataFrame, spread: Spread = HOT) -> DataFrame:
    return membership_history(log, spread).where(F.col("outcome") != "accepted").drop("_left")


def connection_changes(intervals: DataFrame) -> DataFrame:
    """+1 at every opening, -1 at every closing."""
    opened = intervals.select("room_id", "user_id", F.col("joined_at").alias("t_us"), F.col("join_id").alias("event_id"), F.lit(1).cast("bigint").alias("delta"))
    closed = intervals.where(F.col("left_at").isNotNull()).select(
        "room_id", "user_id", F.col("left_at").alias("t_us"), F.col("leave_id").alias("event_id"), F.lit(-1).cast("bigint").alias("delta")
    )
    return opened.unionByName(closed)


def in_trimmed_rooms(messages: DataFrame) -> DataFrame:
    """Messages under the name their room has in the membership log."""
    return messages.withColumn("room_id", trim_space(F.col("room_id")))


def with_audience(messages: DataFrame, intervals: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Add ``audience``: how many members are present when the message is broadcast.

    Counting members is a running sum of joins and leaves per room, so no
    message is compared with any member.
    """
    steps = connection_changes(intervals).select(
        "room_id", "t_us", F.lit(0).alias("_kind"), F.col("event_id").alias("_id"), "delta"
    )
    line = in_trimmed_rooms(messages).withColumn("_kind", F.lit(1)).withColumn("_id", F.col("event_id")).unionByName(
        steps, allowMissingColumns=True
    )
    counted = running(line, ["room_id"], "t_us", ["t_us", "_kind", "_id"], Running(sums={"audience": "delta"}), spread)
    return counted.where(F.col("_kind") == 1).select(*messages.columns, "audience")


def heard(messages: DataFrame, intervals: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Messages that somebody receives."""
    return with_audience(messages, intervals, spread).where(F.col("audience") > 0)


def unheard(messages: DataFrame, intervals: DataFrame, spread: Spread = ALL) -> DataFrame:
    """Messages dropped because the room is empty; they take no sequence number."""
    return with_audience(messages, intervals, spread).where(F.col("audience") == 0)


def room_sequence(messages: DataFrame, offsets_per_slice: int = OFFSETS_PER_SLICE) -> DataFrame:
    """Number the messages of each room 1, 2, 3, ... in log order.

    A room lives in one partition of the log, so ``off`` orders it totally.
    """
    one = in_trimmed_rooms(messages).withColumn("_one", F.lit(1).cast("bigint"))
    numbered = running(
        one, ["room_id"], "off", ["off"], Running(sums={"sequence": "_one"}), Spread(width_us=offsets_per_slice)
    )
    return numbered.drop("_one")


def fanout(
    messages: DataFrame, intervals: DataFrame, slice_us: int = HOUR_US, times: DataFrame | None = None, received: DataFrame | None = None
) -> DataFrame:
    """One row per message and member present at that moment, the sender included.

    ``times`` is any table whose ``t_us`` covers the messages' time range; give
    the stored table when ``messages`` is costly to compute a second time.
    With ``received`` (``event_id, member_id``) only those that are not in it:
    the receipts go along with their message, so deliveries, of which there are
    many times more than messages and stays, are never shuffled.

    Stays are laid out over time slices, so the join key is (room, slice) and a
    busy room is spread over as many tasks as it has slices; the messages of a
    crowded slice are dealt to pieces of about ``MESSAGES``, each of which meets
    all stays of the slice. A stay goes only into slices in which its room has a
    message: first into stretches of ``STRETCH`` slices, then into the slices of
    the stretches that are left, so a stay that lasts for years costs as much as
    there is to deliver. Short slices lie in stretches of stretches, so that no
    stay is laid out over more than one number a day at once.
    """
    covering = in_trimmed_rooms(messages if times is None else times)

    def within(stays: DataFrame, name: str, width: int, outer: str | None) -> DataFrame:
        """The stays once for each number of this width that they touch and the room has messages in."""
        def number(c):
            return floor_div(c, width)

        start, end = number(F.col("joined_at")), number(F.coalesce("left_at", F.col("_last")))
        if outer:
            start, end = F.greatest(start, F.col(outer) * STRETCH), F.least(end, F.col(outer) * STRETCH + STRETCH - 1)
        else:
            start, end = F.greatest(start, number(F.col("_first"))), F.least(end, number(F.col("_last")))
        laid = stays.withColumns({"_from": start, "_to": end}).where("_from <= _to").withColumn(name, F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")
        spoken = covering.select("room_id", number(F.col("t_us")).alias(name)).distinct()
        return laid.join(spoken, ["room_id", name], "left_semi")

    def in_pieces(rows: DataFrame, piece: Column) -> DataFrame:
        """With ``_piece``; only slices with more than one are broadcast, at most one row for ``MESSAGES`` messages."""
        counts = covering.groupBy("room_id", floor_div(F.col("t_us"), slice_us).alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
        crowded = counts.where(F.col("_n") > MESSAGES).select("room_id", "_slice", F.ceil(F.col("_n") / MESSAGES).alias("_crowd"))
        found = rows.join(F.broadcast(crowded), ["room_id", "_slice"], "left").withColumn("_pieces", F.coalesce("_crowd", F.lit(1).cast("bigint")))
        return found.withColumn("_piece", piece).drop("_crowd", "_pieces")

    spans = covering.groupBy("room_id").agg(F.min("t_us").alias("_first"), F.max("t_us").alias("_last"))
    stays = intervals.select("room_id", F.col("user_id").alias("member_id"), "joined_at", "left_at").join(spans, "room_id")
    widths = [slice_us * STRETCH]
    while widths[0] < DAY_US:
        widths.insert(0, widths[0] * STRETCH)
    outer = None
    for i, width in enumerate(widths):
        name = f"_stretch{i}"
        stays, outer = within(stays, name, width, outer), name
    stays = within(stays, "_slice", slice_us, outer).drop("_first", "_last", *(f"_stretch{i}" for i in range(len(widths))))
    stays = in_pieces(stays, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)))
    sliced = in_trimmed_rooms(messages).withColumn("_slice", floor_div(F.col("t_us"), slice_us))
    sliced = in_pieces(sliced, F.pmod(F.xxhash64("event_id", "t_us"), F.col("_pieces")))
    present = (F.col("joined_at") <= F.col("t_us")) & (F.col("left_at").isNull() | (F.col("t_us") < F.col("left_at")))
    cell = ["room_id", "_slice", "_piece"]
    if received is not None:
        sliced, stays = _with_receipts(sliced, stays, received)
        cell.append("_part")
        present &= ~F.coalesce(F.array_contains("_received", F.col("member_id")), F.lit(False))
    # Adaptive execution merges tasks by the bytes they read, which say nothing of the rows they make: a few large tasks,
    # the last of which waits for a free core. The size estimate does not know how far the stays were laid out, so never
    # broadcast them.
    tasks = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced, stays = sliced.repartition(tasks, *cell), stays.repartition(tasks, *cell)
    return sliced.join(stays.hint("merge"), cell).where(present).select(*messages.columns, "member_id")


def _with_receipts(sliced: DataFrame, stays: DataFrame, received: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages once per ``_part`` of the members, with those of the part that got them, and stays with their part.

    A room's slice has one part per ``RECEIPTS`` receipts of its message with the most, so lists stay short and there
    are about as many rows as receipts at most, save where few messages of a slice have nearly all of them.
    """
    def part(member: Column) -> Column:
        return F.pmod(F.xxhash64(member), F.col("_parts"))

    got = _receipts(received)
    counts = got.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"))
    most = F.ceil(F.coalesce(F.max("_n"), F.lit(1)) / RECEIPTS)
    cells = sliced.select("event_id", "room_id", "_slice").join(counts, "event_id", "left").groupBy("room_id", "_slice").agg(most.alias("_parts"))
    said = sliced.join(cells, ["room_id", "_slice"])
    # one event_id may stand for several messages
    lists = got.join(said.select("event_id", "_parts").distinct(), "event_id").groupBy(
        "event_id", "_parts", part(F.col("member_id")).alias("_part")
    ).agg(F.collect_list("member_id").alias("_received"))
    said = said.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    there = stays.join(cells, ["room_id", "_slice"]).withColumn("_part", part(F.col("member_id")))
    return said.join(lists, ["event_id", "_parts", "_part"], "left"), there


def _receipts(received: DataFrame) -> DataFrame:
    return received.select("event_id", "member_id").where("event_id IS NOT NULL AND member_id IS NOT NULL").distinct()


def missed_deliveries(
    expected: DataFrame, received: DataFrame, intervals: DataFrame | None = None, slice_us: int = HOUR_US, times: DataFrame | None = None,
    counted: Spread | None = None,
) -> DataFrame:
    """Expected deliveries that never reached the client.

    With ``intervals`` ``expected`` are the numbered messages, and the fan-out to
    the members present is made here, leaving out what was received. With
    ``counted`` as well, what they are per ``event_id`` (``missed``) and not one
    row for each: time then grows with messages, stays and receipts.
    """
    if intervals is None:
        return expected.join(received, ["event_id", "member_id"], "left_anti")
    if counted is not None:
        return _missed_counts(expected, received, intervals, counted)
    return fanout(expected, intervals, slice_us, times, received)


def _missed_counts(messages: DataFrame, received: DataFrame, intervals: DataFrame, spread: Spread) -> DataFrame:
    """``event_id, missed``: members present at a message less those of them that got it.

    Both are running sums of joins and leaves, per room and per member of a room,
    so no message is laid out over its members.
    """
    # stays that the fan-out can deliver to
    stays = intervals.where("room_id IS NOT NULL AND joined_at IS NOT NULL AND (left_at IS NULL OR joined_at < left_at)")
    present = with_audience(messages, stays, spread).select("event_id", F.col("audience").alias("missed"))
    said = in_trimmed_rooms(messages).select("event_id", "room_id", "t_us")
    got = said.join(_receipts(received), "event_id").select("event_id", "room_id", F.col("member_id").alias("user_id"), "t_us", F.lit(1).alias("_kind"))
    steps = connection_changes(stays).where(F.col("user_id").isNotNull()).select("room_id", "user_id", "t_us", F.lit(0).alias("_kind"), "delta")
    there = running(
        got.unionByName(steps, allowMissingColumns=True), ["room_id", "user_id"], "t_us", ["t_us", "_kind"], Running(sums={"_there": "delta"}), spread
    )
    reached = there.where((F.col("_kind") == 1) & (F.col("_there") > 0)).select("event_id", (-F.col("_there")).alias("missed"))
    return present.unionByName(reached).groupBy("event_id").agg(F.sum("missed").alias("missed")).where(F.col("missed") > 0)


def dropped_clients(missed: DataFrame) -> DataFrame:
    """Per message, how many members lost it; ``missed`` are the deliveries, or how many they are per ``event_id``."""
    n = F.coalesce(F.sum("missed"), F.lit(0)) if "missed" in missed.columns else F.count(F.lit(1))
    return missed.groupBy("event_id").agg(n.alias("dropped_clients"))


def order_violations(arrivals: DataFrame, keys: list[str], position: str, spread: Spread = ALL) -> DataFrame:
    """Rows whose ``position`` does not exceed that of the row that arrived before."""
    seen = running(arrivals, keys, "t_us", ["t_us", position], Running(prev={"previous": position}), spread)
    return seen.where(F.col(position) <= F.col("previous"))
