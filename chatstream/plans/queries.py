"""Named queries over the generated tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from fractions import Fraction
from functools import cached_property, reduce

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstream.functions.hashing import partition_for_room
from chatstream.functions.text import clean_words, first_match, trim_space
from chatstream.functions.urls import valid_lease
from chatstream.operators import delivery, envelope, metrics, moderation, ownership, publish, ratelimit, rooms, routing
from chatstream.operators.ordered import Spread
from chatstream.plans import flow
from chatstream.plans.views import spark_view
from chatstream.schema import ECHO_PREFIX
from chatstream.session import configure, shared_dir, stored
from chatstream.sources.bus import audit_log_files, read_log_files, with_offsets, write_log_files
from chatstream.streaming import operators as streams
from chatstream.streaming.run import consume, read_files, split_log, write_files

Query = Callable[[SparkSession, str], DataFrame]

# parameters of the queries on this data
WORDS = [" CHTER ", "ouelle", "", "thin "]
MANY_WORDS = [a + b for a in ("ch", "re", "on", "la", "ei", "ou", "ti", "ve", "no", "st") for b in ("ent", "tio", "eau", "der", "ich", "ier", "ment", "que", "ung", "ado")]
FLOW_RATE, FLOW_BURST = 5, 3
LIMIT_RATE, LIMIT_BURST = Fraction(1, 20_000), 2
PARTITIONS = [0, 1, 2]
SILENCE_US = 3_600_000_000

QUERIES: dict[str, Query] = {}


class Tables:
    """The derived inputs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir.rstrip("/")

    def __getattr__(self, view: str) -> DataFrame:
        return spark_view(self.spark, self.sf_dir, view)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def all(self) -> Spread:
        """Slices fitted to the event table, for calculations that cut every key."""
        return Spread.fit(self.limiter_events, "t_us")

    @cached_property
    def hot(self) -> Spread:
        """The same slices, for calculations that cut only very busy keys."""
        return replace(self.all, mode="hot")

    @cached_property
    def intervals(self) -> DataFrame:
        return stored(rooms.membership_intervals(self.membership_log, self.hot), "intervals")

    @cached_property
    def frame_slices(self) -> Spread:
        return Spread.fit(self.frames, "t_us")

    @property
    def moderated(self) -> DataFrame:
        return moderation.moderate(self.frames, WORDS)

    @property
    def checked(self) -> DataFrame:
        return flow.check_frames(self.frames, WORDS, FLOW_RATE, FLOW_BURST, replace(self.frame_slices, mode="hot"), self.consumers, self.frame_slices)

    @property
    def deliveries(self) -> DataFrame:
        return flow.deliver(self.messages, self.intervals, self.all)

    @property
    def numbered(self) -> DataFrame:
        return flow.broadcast_messages(self.messages, self.intervals, self.all).select("event_id", "room_id", "t_us", "sequence")

    @property
    def missed(self) -> DataFrame:
        return rooms.missed_deliveries(self.numbered, self.receipts, self.intervals, times=self.messages)

    @property
    def dropped(self) -> DataFrame:
        """Only how many deliveries were missed is asked for, so they are counted and not laid out."""
        return rooms.dropped_clients(rooms.missed_deliveries(self.numbered, self.receipts, self.intervals, counted=self.all))


def query(fn: Callable[[Tables], DataFrame]) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


# --- frames -------------------------------------------------------------------


@query
def frames_scan(t):
    return t.frames.select("conn_id", "frame_no", "room_id", "user_id", "t_us", F.octet_length("payload").alias("n_bytes"))


@query
def moderation_reasons(t):
    return t.moderated.select("conn_id", "frame_no", "reject_reason")


@query
def json_edge_cases(t):
    return moderation.moderate(t.json_cases, WORDS).select("conn_id", "reject_reason")


@query
def sensitive_first_match(t):
    return t.table("documents").select("doc_id", first_match(F.col("text"), WORDS).alias("word"))


@query
def sensitive_many_words(t):
    return t.table("documents").select("doc_id", first_match(F.col("text"), MANY_WORDS).alias("word"))


@query
def dictionary_clean(t):
    words = clean_words(F.array("first_word", "blank_word", "last_word", F.lit("")))
    return t.word_lists.select("p_partkey", F.concat_ws("|", words).alias("words"))


@query
def terminal_cutoff(t):
    return moderation.cut_after_terminal(t.moderated).select("conn_id", "frame_no", "reject_reason")


@query
def protocol_errors(t):
    return moderation.protocol_errors(t.checked).select("conn_id", "frame_no", "reject_reason", "code", "message", "action")


@query
def rejections_by_reason(t):
    return metrics.rejections_by_reason(t.checked)


@query
def metrics_counters(t):
    return metrics.frame_counters(t.checked).withColumn("value", F.col("value").cast("bigint"))


@query
def handshake_reasons(t):
    placed = t.handshakes.withColumn("part", partition_for_room(trim_space(F.col("room_id")), PARTITIONS))
    owned = ownership.with_owner(placed, t.ownership_log, t.all).withColumn("owned", F.col("instance_id") == F.col("gateway"))
    return moderation.check_handshakes(owned).select("event_id", "user_id", "room_id", "reject_reason")


# --- envelopes and the log ----------------------------------------------------


def _accepted(t):
    return t.checked.where(F.col("reject_reason").isNull())


@query
def envelope_build(t):
    return envelope.build_envelope(_accepted(t)).select(
        "message_id", "room_id", "user_id", "content",
        F.col("sequence").cast("bigint").alias("sequence"), F.unix_micros("created_at").alias("created_us"),
    )


@query
def message_ids(t):
    return t.frames.select("conn_id", "frame_no", envelope.message_id(F.col("conn_id"), F.col("frame_no"), F.col("t_us")).alias("message_id"))


@query
def envelope_validate(t):
    return envelope.validate(t.envelopes).select("event_id", "invalid_code")


@query
def bus_encode(t):
    messages = t.messages.select(
        envelope.message_id(F.col("event_id")).alias("message_id"), "room_id", "user_id", "content",
        F.lit(0).cast("decimal(20,0)").alias("sequence"), F.timestamp_micros("t_us").alias("created_at"),
    )
    return envelope.encode(messages).select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query
def bus_scan(t):
    return envelope.valid_messages(envelope.decode(t.bus_log)).select(
        "part", "off", "message_id", "room_id", "user_id", "content",
        F.col("sequence").cast("bigint").alias("sequence"), F.unix_micros("created_at").alias("created_us"),
    )


@query
def log_export(t):
    """The records through a log of files, and what the files say of their order."""
    path = shared_dir(t.spark, "log")
    write_log_files(t.bus_log, path)
    return audit_log_files(t.spark, path)


@query
def flow_log(t):
    """Accepted frames as the log holds them: written, read back and decoded."""
    path = shared_dir(t.spark, "log")
    flow.write_log(t.checked, PARTITIONS, path, spread=t.frame_slices)
    messages, _ = flow.read_log(read_log_files(t.spark, path))
    return messages.select("part", "off", "message_id", "room_id", "user_id", "content", F.col("t_us").alias("created_us"))


@query
def flow_deliveries(t):
    """Frames to deliveries through the written log."""
    hot = replace(t.frame_slices, mode="hot")
    delivered = flow.run(t.frames, t.consumers, t.connections, PARTITIONS, WORDS, FLOW_RATE, FLOW_BURST, hot, t.frame_slices)
    return delivered.select("part", "off", "message_id", "room_id", "sequence", "content", "member_id")


@query
def poison_records(t):
    return envelope.poison_records(envelope.decode(t.bus_log))


@query
def room_partition(t):
    return t.messages.select("event_id", "room_id", partition_for_room(F.col("room_id"), PARTITIONS).alias("part"))


# --- rate limit ---------------------------------------------------------------


@query
def rate_limit(t):
    return ratelimit.rate_limit(t.limiter_events, LIMIT_RATE, LIMIT_BURST, spread=t.hot).select("user_id", "event_id", "allowed")


@query
def rate_limit_per_gateway(t):
    limited = ratelimit.rate_limit(t.attempts, LIMIT_RATE, LIMIT_BURST, per="published", spread=t.hot)
    return limited.select("user_id", "event_id", "allowed")


@query
def publish_gate(t):
    limited = ratelimit.rate_limit(t.attempts, LIMIT_RATE, LIMIT_BURST, spread=t.hot)
    at = publish.with_readiness(limited, t.consumer_log, t.all)
    reason = F.when(~F.col("allowed"), "rate_limit")
    return at.select("event_id", publish.publish_reason(reason, F.col("bus_ready"), F.col("message_id"), F.col("published")).alias("reject_reason"))


# --- rooms --------------------------------------------------------------------


@query
def membership_intervals(t):
    return rooms.membership_intervals(t.membership_log, t.hot)


@query
def membership_rejects(t):
    return rooms.membership_rejects(t.membership_log, t.hot).select("event_id", "room_id", "user_id", "kind", "outcome")


@query
def audience_semi(t):
    return rooms.heard(t.messages, t.intervals, t.all).select("event_id", "room_id", "audience")


@query
def no_audience_anti(t):
    return rooms.unheard(t.messages, t.intervals, t.all).select("event_id", "room_id")


@query
def room_sequence(t):
    return flow.broadcast_messages(t.messages, t.intervals, t.all).select("event_id", "room_id", "off", "sequence")


@query
def room_sequence_bucketed(t):
    numbered = rooms.room_sequence(t.messages, offsets_per_slice=1_000)
    return numbered.select("event_id", "room_id", "off", "sequence")


@query
def fanout(t):
    return t.deliveries.select("event_id", "room_id", "sequence", "content", "member_id")


@query
def missed_deliveries(t):
    return t.missed.select("event_id", "sequence", "member_id")


@query
def dropped_clients(t):
    return t.dropped


@query
def order_violations(t):
    return rooms.order_violations(t.arrivals, ["room_id"], "off", t.all).select("room_id", "off", "previous")


# --- ownership ----------------------------------------------------------------


@query
def ownership_revisions(t):
    return ownership.revisions(t.ownership_log, t.all)


@query
def assigned_partitions(t):
    return ownership.assigned_partitions(t.ownership_log).select(
        "event_id", "instance_id", F.concat_ws(",", F.transform("partitions", lambda p: p.cast("string"))).alias("partitions")
    )


@query
def room_ownership(t):
    placed = t.messages.withColumn("part", partition_for_room(F.col("room_id"), PARTITIONS))
    return ownership.with_owner(placed, t.ownership_log, t.all).select("event_id", "room_id", "part", "instance_id", "changed_by")


@query
def rebalance_closed(t):
    return ownership.rebalance_closed(t.intervals, t.ownership_log, t.all).select("join_id", "joined_at", "closed_at", "by_rebalance")


@query
def handshake_recheck(t):
    return ownership.handshake_recheck(t.handshakes, t.ownership_log, t.all)


@query
def assignment_violations(t):
    return ownership.assignment_violations(t.assigned_log, t.topic_partitions).select("event_id", "instance_id", "part")


@query
def ownership_exclusive(t):
    return ownership.ownership_exclusive(t.claims, t.topic_partitions).select("event_id", "part", "owners", "problem")


@query
def lease_reconcile(t):
    return ownership.lease_reconcile(t.ownership_log, t.all).select("event_id", "part", "instance_id", "action")


# --- leases -------------------------------------------------------------------


@query
def lease_key(t):
    key = routing.lease_key(F.col("prefix"), F.col("topic"), F.col("consumer_group"), F.col("part"))
    return t.lease_offers.select("event_id", key.alias("lease_key"))


@query
def lease_valid(t):
    valid = valid_lease(F.col("gateway_id"), F.col("websocket_url"), F.col("token"))
    return t.lease_offers.select("event_id", valid.alias("valid"))


@query
def route_lookup(t):
    log = t.lease_log
    probes = log.where(F.col("kind") == "resolve").select("event_id", "t_us", "part")
    return routing.route_lookup(probes, log.where(F.col("kind") != "resolve"), t.all)


@query
def route_by_room(t):
    return routing.route_requests(t.route_requests, t.lease_log.where(F.col("kind") != "resolve"), PARTITIONS, t.all)


# --- delivery audit -----------------------------------------------------------


@query
def echo_parse(t):
    return delivery.parse_echo(t.received_echo).select("user_id", "content", "sent_ns", "received_ns", "latency_ns")


@query
def first_echo(t):
    return delivery.first_echo(t.received_echo).select("user_id", "content", "latency_ns", "copies")


@query
def sent_delivery(t):
    return delivery.sent_delivery(t.sent, t.received_echo).select("event_id", "user_id", "copies", "latency_ns")


@query
def delivery_report(t):
    return delivery.delivery_report(t.sent, t.received_echo, t.client_errors)


@query
def latency_percentiles(t):
    return delivery.floor_percentiles(delivery.first_echo(t.received_echo), "latency_ns", [50, 95, 99])


@query
def latency_percentiles_by_user(t):
    return delivery.floor_percentiles(delivery.first_echo(t.received_echo), "latency_ns", [50, 95, 99], by=["user_id"])


# --- metrics ------------------------------------------------------------------


def _histograms(t: Tables) -> DataFrame:
    """Time to publish a message, and to hand a consumed one to its room."""
    published = metrics.latency_histogram(t.timings, "seconds", "chatstream_publish_duration_seconds")
    return published.unionByName(metrics.latency_histogram(t.timings, "handler_seconds", "chatstream_consumer_handler_duration_seconds"))


@query
def latency_histogram(t):
    return _histograms(t).withColumn("value", F.col("value").cast("double"))


@query
def metrics_lines(t):
    return metrics.metrics_lines(metrics.frame_counters(t.checked).unionByName(_histograms(t)))


@query
def metrics_scrape(t):
    """Every metric of the flow in one table."""
    dropped = t.dropped.agg(F.coalesce(F.sum("dropped_clients"), F.lit(0)).alias("dropped"))
    peak = metrics.connections_peak(rooms.connection_changes(t.intervals), t.all)
    parts = [
        metrics.frame_counters(t.checked),
        _histograms(t),
        metrics.samples(dropped, {"room_client_messages_dropped_total": "dropped"}),
        metrics.samples(peak, {"websocket_connections_current": "current"}),
        metrics.samples(
            metrics.consumer_state(t.consumer_log),
            {"consumer_running": "running", "consumer_ready": "ready", "consumer_restarts_total": "restarts"},
            label="instance_id",
        ),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("value", F.col("value").cast("double"))


@query
def connections_gauge(t):
    changes = rooms.connection_changes(t.intervals)
    return metrics.connections_gauge(changes, t.all).select("event_id", "t_us", "delta", "connections")


@query
def connections_peak(t):
    return metrics.connections_peak(rooms.connection_changes(t.intervals), t.all)


@query
def connection_durations(t):
    return metrics.connection_durations(t.intervals)


@query
def consumer_state(t):
    return metrics.consumer_state(t.consumer_log)


@query
def access_log(t):
    return metrics.access_log(t.access_rows).select("event_id", "method", "path", "status", "latency_ms", "client_ip", "level")


@query
def access_summary(t):
    return metrics.access_summary(t.access_rows)


@query
def liveness_timeouts(t):
    return metrics.liveness_timeouts(t.pongs, SILENCE_US, spread=t.hot)


# --- streams: the whole table goes through a stateful query, then the files it wrote are read ---

#: Later than all data; pushes the watermark past the last row.
END_US = 4_102_444_800_000_000
#: Offsets and times of the message log are less than this apart.
DISORDER = "20 minutes"
#: Batches by time; and such that one row in thirteen comes a batch later than it should.
TEN_DAYS = "cast(date_diff(timestamp_micros(t_us), timestamp'2024-01-01') div 10 AS int)"
LATE_BATCH = f"least(3, {TEN_DAYS} + if(event_id % 13 = 0, 1, 0))"


def _stream(t: Tables, rows: DataFrame, batches: str | None = None, parts: int | None = None, **last) -> DataFrame:
    """Rows stored as a folder and read as a stream, closed by one late row of its own key.

    With ``batches``, an expression, the rows come in as many micro-batches as it has values, in their order; with
    ``parts``, how many they are at most, in any order.
    """
    path = shared_dir(t.spark, "input")
    if batches is None:
        rows.write.parquet(path)
    elif parts:
        rows.repartitionById(parts, F.expr(batches).cast("int")).write.parquet(path)
    else:
        held = stored(rows.withColumn("_batch", F.expr(batches)), "batches")
        for batch in sorted(r[0] for r in held.select("_batch").distinct().collect()):
            held.where(F.col("_batch") == batch).drop("_batch").repartition(1).write.mode("append").parquet(path)
    if last:
        end = [F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
        t.spark.range(1).select(*end).write.mode("append").parquet(path)
    return read_files(t.spark, rows.schema, path, 1 if batches else None)


def _stretches(rows: DataFrame, shortest_us: int, most: int) -> str:
    """Batches by time: stretches of one length, about ``most`` of them however long the rows go on."""
    first, last = rows.agg(F.min("t_us"), F.max("t_us")).first()
    first, last = first or 0, last or 0
    return f"coalesce((t_us - {first}) div {max(shortest_us, -(-(last - first + 1) // most))}, 0)"


def _run(t: Tables, result: DataFrame) -> DataFrame:
    path = shared_dir(t.spark, "output")
    write_files(result, path, shared_dir(t.spark, "checkpoint"), state_partitions=t.spark.sparkContext.defaultParallelism)
    return t.spark.read.schema(result.schema).parquet(path)


def _arrived(t: Tables) -> DataFrame:
    """Messages as a log holds them: offsets in the order of arrival, which is not that of their times."""
    return with_offsets(t.arrived, PARTITIONS, ["arrived_us", "event_id"], t.all).select("part", "off", "room_id", "user_id", "event_id", "t_us", "content")


def _timeline(t: Tables, batches: str | None = None) -> DataFrame:
    """Messages with their audience and stays by slice, from two streams."""
    membership = _stream(t, t.membership_log, batches)
    messages = _stream(t, _arrived(t), batches, room_id="end", user_id="end", content="end", event_id=-1, t_us=END_US)
    return _run(t, streams.stream_timeline(membership, messages, delay=DISORDER))


def _delivered(t: Tables, numbered: DataFrame, stays: DataFrame) -> DataFrame:
    """The stream hands over the deliveries of a message as lists; whoever reads its files gets them as rows."""
    return streams.unpacked(_run(t, streams.stream_deliveries(_stream(t, numbered), _stream(t, stays), delay=DISORDER, packed=True)))


@query
def stream_ingest(t):
    log = _stream(t, t.bus_log, topic="end", part=0, off=-1, value="")
    path = shared_dir(t.spark, "records")
    consume(log, path, shared_dir(t.spark, "checkpoint")).awaitTermination()
    stored = t.spark.read.schema(split_log(t.bus_log).schema).parquet(path)
    return stored.where(F.col("off") >= 0).select("part", "off", "record_class", "error_class", "invalid_code", "message_id", "room_id")


@query
def stream_resume(t):
    """The log in four bounded batches; the handler of the second fails, and the query resumes from its checkpoint."""
    log = _stream(t, t.bus_log, "off % 4", 4, topic="end", part=0, off=-1, value="")
    records, handled, checkpoint = (shared_dir(t.spark, purpose) for purpose in ("records", "handled", "checkpoint"))

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.select("part", "off").write.mode("overwrite").parquet(f"{handled}/batch_id={batch_id}")

    def unavailable(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("the rooms are not reachable")
        deliver(batch, batch_id)

    try:
        consume(log, records, checkpoint, unavailable).awaitTermination()
    except StreamingQueryException:
        consume(log, records, checkpoint, deliver).awaitTermination()
    kept = t.spark.read.schema(split_log(t.bus_log).schema).parquet(records).where(F.col("off") >= 0)
    done = t.spark.read.schema("part int, off bigint").parquet(handled).groupBy("part", "off").agg(F.count("*").alias("handled"))
    return kept.join(done, ["part", "off"], "left").select("part", "off", "record_class", F.coalesce("handled", F.lit(0)).alias("handled"))


@query
def stream_rate_limit(t):
    return _run(t, streams.stream_rate_limit(_stream(t, t.limiter_events, user_id="end", event_id=-1, t_us=END_US), LIMIT_RATE, LIMIT_BURST))


@query
def stream_late(t):
    """Events in four batches, some of them long after their time: the limiter's verdicts, and what came too late."""
    late = _stream(t, t.limiter_events, LATE_BATCH, user_id="end", event_id=-1, t_us=END_US)
    result = _run(t, streams.stream_rate_limit(late, LIMIT_RATE, LIMIT_BURST, delay="1 hour", late=True))
    event = F.coalesce("event_id", F.get_json_object("late_row", "$.event_id").cast("bigint"))
    return result.select(event.alias("event_id"), F.col("late_row").isNotNull().alias("late"), "allowed").where("event_id >= 0")


@query
def stream_sequence(t):
    """Log records in three batches that leave gaps for each other to fill."""
    log = _arrived(t).withColumn("audience", F.lit(1).cast("bigint"))
    return _run(t, streams.stream_sequence(_stream(t, log, "off % 3", 3))).select("room_id", "event_id", "sequence")


@query
def stream_rooms(t):
    """Join/leave log and message log to numbered deliveries, in three streams that hand over files."""
    timeline = _timeline(t, TEN_DAYS)
    messages, stays = timeline.where(F.col("member_id").isNull()), timeline.where(F.col("member_id").isNotNull())
    numbered = _run(t, streams.stream_sequence(_stream(t, messages.where("event_id >= 0"), "off % 3", 3)))
    return _delivered(t, numbered, stays).select("room_id", "event_id", "sequence", "content", "member_id")


@query
def stream_fanout(t):
    """The last step on its own: messages numbered in batch, delivered as a stream."""
    stays = _timeline(t).where(F.col("member_id").isNotNull())
    numbered = flow.broadcast_messages(_arrived(t), t.intervals, t.all).select("room_id", "event_id", "t_us", "sequence", "content")
    return _delivered(t, numbered, stays).select("room_id", "event_id", "sequence", "member_id")


@query
def stream_leases(t):
    log = _stream(t, t.lease_log, part=-1, kind="release", token="end", gateway_id="", websocket_url="", ttl_us=0, event_id=-1, t_us=END_US)
    return _run(t, streams.stream_leases(log))


@query
def stream_liveness(t):
    return _run(t, streams.stream_liveness(_stream(t, t.pongs, conn_id=-1, event_id=-1, t_us=END_US), SILENCE_US))


@query
def stream_dedup(t):
    # by arrival: an envelope need not say when it was made
    once = t.envelopes.withColumn("received_at", F.col("received_at").cast("timestamp")).select("event_id", "received_at")
    twice = once.unionByName(once).withColumn("message_id", F.concat(F.lit("m-"), "event_id"))
    end = {"message_id": "end", "event_id": -1, "received_at": "2100-01-01 00:00:00"}
    return _run(t, streams.stream_dedup(_stream(t, twice, **end), "received_at").where(F.col("event_id") >= 0).select("event_id", "message_id"))


@query
def stream_echo(t):
    sent = _stream(t, t.sent, event_id=-1, user_id="end", content="end", sent_ns=END_US * 1000)
    received = _stream(t, t.received_echo, user_id="end", content=f"{ECHO_PREFIX}:end:{END_US * 1000}", received_ns=END_US * 1000)
    return _run(t, streams.stream_echo(sent, received, longest="400 days"))


@query
def stream_metrics(t):
    end = {"conn_id": -1, "frame_no": 0, "room_id": "end", "user_id": "end", "t_us": END_US, "payload": "", "instance_id": -1}
    # the same stretches of time for both, so neither stream's watermark runs ahead of the other's rows
    batches = _stretches(t.frames, 40_000_000, 8)
    frames, consumers = _stream(t, t.frames, batches, **end), _stream(t, t.consumers, batches)
    counted = streams.stream_metrics(frames, consumers, WORDS, FLOW_RATE, FLOW_BURST)
    return _run(t, counted)


@query
def stream_histogram(t):
    timed = _stream(t, t.timings, event_id=-1, t_us=END_US, seconds=0)
    return _run(t, streams.stream_histogram(timed, "seconds", "1 day")).withColumn("total", F.col("total").cast("double"))
