"""DuckDB SQL that computes each query's result in another way."""

from __future__ import annotations

from chatstream import schema as S
from chatstream.operators.routing import DEFAULT_PREFIX
from chatstream.plans import queries as Q
from chatstream.plans.views import JSON_CASES, RARE, RARE_CASES, URL_CASES, duckdb_view


def _with(views: list[str], *steps: str, recursive: bool = False) -> str:
    """Views and named steps as one WITH list, then the last item as the query."""
    *ctes, final = steps
    head = "with recursive " if recursive else "with "
    return head + ",\n".join([*map(duckdb_view, views), *ctes]) + "\n" + final


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CLEAN = [w.strip().lower() for w in Q.WORDS if w.strip()]
_FNV = (
    "list_reduce(list_prepend(cast(2166136261 as bigint), list_transform(string_split({k}, ''), "
    "lambda c: cast(ascii(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
)


def _part(key: str) -> str:
    h = _FNV.format(k=key)
    return f"cast(abs(case when {h} > 2147483647 then {h} - 4294967296 else {h} end % 3) as int)"


# --- shared steps ---------------------------------------------------------------

_MODERATED = f"""decoded as (
  select *, case when json_valid(payload) then coalesce(json_type(payload, '$.content'), 'NULL') end as content_type,
    case when json_valid(payload) then json_extract_string(payload, '$.content') end as content from frames
), moderated as (
  select conn_id, frame_no, room_id, user_id, t_us, content, instance_id, id_failed, write_failed,
    case when strlen(payload) > {S.MAX_FRAME_BYTES} then 'frame_too_large'
         when content_type is null or content_type not in ('VARCHAR', 'NULL') then 'invalid_json'
         when trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' then 'empty_content'
         when length(content) > {S.MAX_CONTENT_CHARS} then 'content_too_long'
         when len(list_filter({_list(_CLEAN)}, lambda w: contains(lower(content), w))) > 0 then 'sensitive_content'
    end as reject_reason
  from decoded
)"""

_ADMITTED = """admitted as (
  select * from (
    select *, coalesce(max(case when reject_reason in ('frame_too_large', 'invalid_json') then 1 else 0 end)
      over (partition by conn_id order by frame_no rows between unbounded preceding and 1 preceding), 0) as gone
    from moderated) where gone = 0
)"""


def _bucket(source: str, order: str, rate: str, burst: int) -> str:
    refill = f"least({burst}.0, b.tokens + (o.t_us - b.t_us) / 1e6 * {rate})"
    return f"""ordered as (
  select *, row_number() over (partition by user_id order by {order}) as rn from {source}
), bucket as (
  select user_id, rn, t_us, cast({burst} - 1 as double) as tokens, true as allowed from ordered where rn = 1
  union all
  select o.user_id, o.rn, o.t_us, case when {refill} >= 1 then {refill} - 1 else {refill} end, {refill} >= 1
  from bucket b join ordered o on o.user_id = b.user_id and o.rn = b.rn + 1
)"""


_CHECKED = [
    _MODERATED,
    _ADMITTED,
    "passed as (select * from admitted where reject_reason is null)",
    _bucket("passed", "t_us, conn_id, frame_no", f"{float(Q.FLOW_RATE)}", Q.FLOW_BURST),
    """limited as (
  select a.*, case when b.allowed = false then 'rate_limit' else a.reject_reason end as limited_reason
  from admitted a left join ordered o on o.conn_id = a.conn_id and o.frame_no = a.frame_no
    left join bucket b on b.user_id = o.user_id and b.rn = o.rn
)""",
    """checked as (
  select l.conn_id, l.frame_no, l.room_id, l.user_id, l.t_us, l.content,
    case when l.limited_reason is not null then l.limited_reason
         when c.kind is distinct from 'ready' then 'message_bus_unavailable'
         when l.id_failed then 'message_id_generation_failed'
         when l.write_failed then 'message_bus_unavailable' end as reject_reason
  from limited l asof left join consumers c on l.instance_id = c.instance_id and l.t_us >= c.t_us
)""",
]

_HISTORY = """history as (
  select *, case when kind = 'join' and before = 'join' then 'already_joined'
                 when kind = 'leave' and coalesce(before, 'leave') = 'leave' then 'client_not_found'
                 else 'accepted' end as outcome
  from (select *, lag(kind) over w as before,
      lead(case when kind = 'leave' then t_us end ignore nulls) over w as next_leave,
      lead(case when kind = 'leave' then event_id end ignore nulls) over w as next_leave_id
    from membership_log window w as (partition by room_id, user_id order by t_us, event_id))
)"""
_INTERVALS = (
    _HISTORY
    + """, intervals as (
  select room_id, user_id, t_us as joined_at, event_id as join_id, next_leave as left_at, next_leave_id as leave_id
  from history where kind = 'join' and outcome = 'accepted'
)"""
)
#: Accepted frames in the order they reach the log, offsets without gaps in each partition.
_LOG = f"""log as (
  select md5(concat_ws(chr(31), conn_id, frame_no, t_us)) as message_id, room_id, user_id, content, t_us, part,
    row_number() over (partition by part order by t_us, conn_id, frame_no) - 1 as off
  from (select *, {_part('room_id')} as part from checked where reject_reason is null)
)"""
_PRESENT = "i.room_id = m.room_id and i.joined_at <= m.t_us and (i.left_at is null or m.t_us < i.left_at)"
_NUMBERED = f"""numbered as (
  select *, row_number() over (partition by room_id order by off) as sequence
  from messages m where exists (select 1 from intervals i where {_PRESENT})
)"""
_ARRIVED = f"""numbered as (
  select *, row_number() over (partition by room_id order by arrived_us, event_id) as sequence
  from arrived m where exists (select 1 from intervals i where {_PRESENT})
)"""
_DELIVERIES = f"""deliveries as (
  select m.*, i.user_id as member_id from numbered m join intervals i on {_PRESENT}
)"""
_MISSED = """missed as (
  select * from deliveries d where not exists (select 1 from receipts r where r.event_id = d.event_id and r.member_id = d.member_id)
)"""
_ROOMS = ["membership_log", "messages"]
_REVISIONS = """revisions as (
  select event_id, t_us, cleared, row_number() over (order by t_us, event_id) as revision
  from (select event_id, t_us, count(*) filter (instance_id is null) as cleared from ownership_log group by all)
)"""
_CHANGES = """changes as (
  select join_id as event_id, joined_at as t_us, 1 as delta from intervals
  union all select leave_id, left_at, -1 from intervals where left_at is not null
)"""
_ECHO = f"""echoes as (
  select user_id, content, try_cast(string_split(content, ':')[3] as bigint) as sent_ns, received_ns
  from received_echo
  where len(string_split(content, ':')) = 3 and string_split(content, ':')[1] = '{S.ECHO_PREFIX}'
    and string_split(content, ':')[2] = user_id and try_cast(string_split(content, ':')[3] as bigint) is not null
), firsts as (
  select user_id, content, min(received_ns) - sent_ns as latency_ns, count(*) as copies
  from echoes group by user_id, content, sent_ns
)"""
_HISTOGRAM = "samples as (\n" + "\nunion all ".join(
    row
    for metric, column in (("publish_duration_seconds", "seconds"), ("consumer_handler_duration_seconds", "handler_seconds"))
    for row in [
        *(
            f"""select 'chatstream_{metric}_bucket' as metric, 'le="{b}"' as labels,
  cast(count(*) filter ({column} <= {b}) as decimal(38,9)) as value from timings"""
            for b in S.LATENCY_BUCKETS
        ),
        f"""select 'chatstream_{metric}_bucket', 'le="+Inf"', count(*) from timings""",
        f"""select 'chatstream_{metric}_sum', '', sum(cast({column} as decimal(28,9))) from timings""",
        f"""select 'chatstream_{metric}_count', '', count(*) from timings""",
    ]
) + "\n)"
_COUNTERS = """counters as (
  select 'chatstream_messages_received_total' as metric, '' as labels,
    count(*) filter (reject_reason is distinct from 'frame_too_large') as value from checked
  union all
  select 'chatstream_messages_rejected_total', 'reason="' || reject_reason || '"', count(*)
  from checked where reject_reason is not null group by reject_reason
)"""


def _case(column: str, pairs) -> str:
    arms = " ".join(f"when {k} then {'null' if v is None else repr(v)}" for k, v in pairs)
    return f"case {column} {arms} end"


def _reason_rows() -> str:
    def text(value):
        return "null" if value is None else f"'{value}'"

    return ", ".join(f"({', '.join(text(v) for v in row)})" for row in S.REASONS)


def _fixed_number(value: str) -> str:
    return f"regexp_replace(cast(cast({value} as decimal(38,9)) as varchar), '\\.?0+$', '')"


def _percentiles(by: str = "") -> str:
    groups = f"{by}, " if by else ""
    group_by = f" group by {by}" if by else ""
    return (
        f"select {groups}p.percent, v[((len(v) - 1) * p.percent) // 100 + 1] as latency_ns from "
        f"(select {groups}list_sort(list(latency_ns)) as v from firsts{group_by}) s cross join (values (50), (95), (99)) p(percent)"
    )


ORACLE: dict[str, str] = {
    "frames_scan": _with(["frames"], "select conn_id, frame_no, room_id, user_id, t_us, strlen(payload) as n_bytes from frames"),
    "moderation_reasons": _with(["frames"], _MODERATED, "select conn_id, frame_no, reject_reason from moderated"),
    "json_edge_cases": f"select event_id as conn_id, case when event_id % {RARE} < {len(RARE_CASES)} then "
    + _case(f"event_id % {RARE}", [(i, r) for i, (_, r) in enumerate(RARE_CASES)]) + " else "
    + _case(f"event_id % {len(JSON_CASES)}", [(i, r) for i, (_, r) in enumerate(JSON_CASES)]) + " end"
    + " as reject_reason from events",
    "sensitive_first_match": f"select doc_id, list_filter({_list(_CLEAN)}, lambda w: contains(lower(text), w))[1] as word from documents",
    "sensitive_many_words": f"select doc_id, list_filter({_list(Q.MANY_WORDS)}, lambda w: contains(lower(text), w))[1] as word from documents",
    "dictionary_clean": "select p_partkey, lower(trim(p_name)) || '|' || lower(trim(p_type)) as words from part",
    "terminal_cutoff": _with(["frames"], _MODERATED, _ADMITTED, "select conn_id, frame_no, reject_reason from admitted"),
    "protocol_errors": _with(
        ["frames", "consumers"], *_CHECKED,
        f"""select c.conn_id, c.frame_no, c.reject_reason, r.code, r.message, r.action from checked c
join (values {_reason_rows()}) r(reason, code, message, action) on r.reason = c.reject_reason""",
        recursive=True,
    ),
    "rejections_by_reason": _with(
        ["frames", "consumers"], *_CHECKED,
        "select reject_reason as reason, count(*) as rejected from checked where reject_reason is not null group by reject_reason",
        recursive=True,
    ),
    "metrics_counters": _with(["frames", "consumers"], *_CHECKED, _COUNTERS, "select * from counters", recursive=True),
    "metrics_lines": _with(
        ["frames", "consumers", "timings"], *_CHECKED, _COUNTERS, _HISTOGRAM,
        f"""select metric || case when labels <> '' then '{{' || labels || '}}' else '' end || ' ' || {_fixed_number('value')} as line
from (select * from counters union all select * from samples)""",
        recursive=True,
    ),
    "handshake_reasons": _with(
        ["handshakes", "ownership_log"],
        f"placed as (select *, trim(user_id) as uid, trim(room_id, ' ' || chr(9)) as rid, {_part('trim(room_id)')} as part from handshakes)",
        """select p.event_id, p.uid as user_id, p.rid as room_id,
  case when not p.ready then 'not_ready' when p.uid = '' then 'missing_user_id' when p.rid = '' then 'missing_room_id'
       when o.instance_id is distinct from p.gateway then 'room_not_owned' end as reject_reason
from placed p asof left join ownership_log o on p.part = o.part and p.t_us >= o.t_us""",
    ),
    "envelope_build": _with(
        ["frames", "consumers"], *_CHECKED,
        """select md5(concat_ws(chr(31), conn_id, frame_no, t_us)) as message_id, room_id, user_id, content, 0 as sequence, t_us as created_us
from checked where reject_reason is null""",
        recursive=True,
    ),
    "message_ids": _with(["frames"], "select conn_id, frame_no, md5(concat_ws(chr(31), conn_id, frame_no, t_us)) as message_id from frames"),
    "envelope_validate": """select event_id, case when event_id % 11 = 0 then 'empty_message_id' when event_id % 13 = 0 then 'empty_room_id'
  when event_id % 17 = 0 then 'empty_user_id' when event_id % 19 = 0 then 'empty_content' when event_id % 23 = 0 then 'empty_created_at' end as invalid_code
from events""",
    "bus_encode": _with(
        ["messages"],
        """select room_id as key, cast(json_object('message_id', md5(cast(event_id as varchar)), 'room_id', room_id, 'user_id', user_id,
  'content', content, 'sequence', 0, 'created_at',
  regexp_replace(strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z') as varchar) as value from messages""",
    ),
    "bus_scan": """select cast(((user_id + event_id) % 10) % 3 as int) as part, event_id as off, 'm-' || event_id as message_id,
  'room-' || (user_id + event_id) % 10 as room_id, 'user-' || user_id as user_id, event_type as content, 0 as sequence, epoch_us(ts) as created_us
from events where event_id % 101 <> 0 and event_id % 103 <> 0 and event_id % 107 <> 0 and event_id % 109 <> 0 and event_id % 113 <> 0""",
    "poison_records": _with(
        ["bus_log"],
        """parsed as (
  select *, case when json_valid(value) then value end as j from bus_log
), fields as (
  select *, json_type(j, '$.message_id') as id_type, j->>'$.message_id' as mid, j->>'$.room_id' as rid, j->>'$.user_id' as uid,
    trim(j->>'$.content') as body, j->>'$.created_at' as created from parsed
), classed as (
  select *, case when j is null or coalesce(id_type, 'VARCHAR') <> 'VARCHAR' then 'malformed' end as bad,
    case when coalesce(mid, '') = '' then 'empty_message_id' when coalesce(rid, '') = '' then 'empty_room_id'
         when coalesce(uid, '') = '' then 'empty_user_id' when coalesce(body, '') = '' then 'empty_content'
         when created is null then 'empty_created_at' end as missing from fields
)""",
        """select topic, part, off, coalesce(bad, 'invalid') as error_class, case when bad is null then missing end as invalid_code,
  case when bad is null then coalesce(mid, '') end as message_id, case when bad is null then coalesce(rid, '') end as room_id
from classed where bad is not null or missing is not null""",
    ),
    "room_partition": _with(["messages"], f"select event_id, room_id, {_part('room_id')} as part from messages"),
    "rate_limit": _with(
        ["limiter_events"], _bucket("limiter_events", "t_us, event_id", "(1 / 20000.0)", Q.LIMIT_BURST),
        "select o.user_id, o.event_id, b.allowed from ordered o join bucket b on b.user_id = o.user_id and b.rn = o.rn",
        recursive=True,
    ),
    "rate_limit_per_gateway": _with(
        ["attempts"],
        "scoped as (select event_id, t_us, cast(published as varchar) || user_id as user_id, user_id as name from attempts)",
        _bucket("scoped", "t_us, event_id", "(1 / 20000.0)", Q.LIMIT_BURST),
        "select o.name as user_id, o.event_id, b.allowed from ordered o join bucket b on b.user_id = o.user_id and b.rn = o.rn",
        recursive=True,
    ),
    "publish_gate": _with(
        ["attempts", "consumer_log"], _bucket("attempts", "t_us, event_id", "(1 / 20000.0)", Q.LIMIT_BURST),
        "changes as (select instance_id, t_us, kind = 'ready' as bus_ready from consumer_log where kind in ('ready', 'not_ready', 'restart'))",
        """select o.event_id, case when not b.allowed then 'rate_limit' when not coalesce(c.bus_ready, false) then 'message_bus_unavailable'
  when o.message_id is null then 'message_id_generation_failed' when not o.published then 'message_bus_unavailable' end as reject_reason
from ordered o join bucket b on b.user_id = o.user_id and b.rn = o.rn
  asof left join changes c on c.instance_id = o.instance_id and o.t_us >= c.t_us""",
        recursive=True,
    ),
    "membership_intervals": _with(["membership_log"], _INTERVALS, "select * from intervals"),
    "membership_rejects": _with(["membership_log"], _HISTORY, "select event_id, room_id, user_id, kind, outcome from history where outcome <> 'accepted'"),
    "audience_semi": _with(
        _ROOMS, _INTERVALS,
        f"select m.event_id, m.room_id, count(*) as audience from messages m join intervals i on {_PRESENT} group by all",
    ),
    "no_audience_anti": _with(
        _ROOMS, _INTERVALS, f"select event_id, room_id from messages m where not exists (select 1 from intervals i where {_PRESENT})"
    ),
    "room_sequence": _with(_ROOMS, _INTERVALS, _NUMBERED, "select event_id, room_id, off, sequence from numbered"),
    "room_sequence_bucketed": _with(["messages"], "select event_id, room_id, off, row_number() over (partition by room_id order by off) as sequence from messages"),
    "fanout": _with(_ROOMS, _INTERVALS, _NUMBERED, _DELIVERIES, "select event_id, room_id, sequence, content, member_id from deliveries"),
    "missed_deliveries": _with([*_ROOMS, "receipts"], _INTERVALS, _NUMBERED, _DELIVERIES, _MISSED, "select event_id, sequence, member_id from missed"),
    "dropped_clients": _with(
        [*_ROOMS, "receipts"], _INTERVALS, _NUMBERED, _DELIVERIES, _MISSED, "select event_id, count(*) as dropped_clients from missed group by event_id"
    ),
    "order_violations": _with(
        ["arrivals"],
        """select room_id, off, previous from (
  select *, lag(off) over (partition by room_id order by t_us, off) as previous from arrivals) where off <= previous""",
    ),
    "ownership_revisions": _with(["ownership_log"], _REVISIONS, "select * from revisions"),
    "assigned_partitions": _with(
        ["ownership_log"],
        """select event_id, instance_id, string_agg(distinct cast(part as varchar), ',' order by cast(part as varchar)) as partitions
from ownership_log where instance_id is not null group by event_id, instance_id""",
    ),
    "room_ownership": _with(
        ["messages", "ownership_log"],
        f"placed as (select event_id, room_id, t_us, {_part('room_id')} as part from messages)",
        """select p.event_id, p.room_id, p.part, o.instance_id, o.event_id as changed_by
from placed p asof left join ownership_log o on p.part = o.part and p.t_us >= o.t_us""",
    ),
    "rebalance_closed": _with(
        ["membership_log", "ownership_log"], _INTERVALS, _REVISIONS,
        """next_change as (
  select i.join_id, i.joined_at, i.left_at, min(r.t_us) as rebalance from intervals i left join revisions r on r.t_us > i.joined_at group by all
)""",
        """select join_id, joined_at, least(left_at, rebalance) as closed_at,
  rebalance is not null and (left_at is null or rebalance < left_at) as by_rebalance from next_change""",
    ),
    "handshake_recheck": _with(
        ["handshakes", "ownership_log"], _REVISIONS,
        """both_ends as (
  select h.event_id, h.registered_us, coalesce(r.revision, 0) as revision_before from handshakes h asof left join revisions r on h.t_us >= r.t_us
)""",
        """select b.event_id, b.revision_before, coalesce(r.revision, 0) as revision_after, b.revision_before = coalesce(r.revision, 0) as accepted
from both_ends b asof left join revisions r on b.registered_us >= r.t_us""",
    ),
    "assignment_violations": _with(
        ["assigned_log", "topic_partitions"],
        """select event_id, instance_id, part from assigned_log a
where not exists (select 1 from topic_partitions p where p.event_id = a.event_id and p.part = a.part)""",
    ),
    "ownership_exclusive": _with(
        ["claims", "topic_partitions"],
        """select p.event_id, p.part, count(distinct c.instance_id) as owners,
  case when count(distinct c.instance_id) = 0 then 'missing' else 'duplicate' end as problem
from topic_partitions p left join claims c on c.event_id = p.event_id and c.part = p.part
group by p.event_id, p.part having count(distinct c.instance_id) <> 1""",
    ),
    "lease_reconcile": _with(
        ["ownership_log"],
        """seen as (
  select *, lag(instance_id) over (partition by part order by t_us, event_id) as old from ownership_log
)""",
        """select event_id, part, instance_id, 'register' as action from seen where instance_id is not null
union all select event_id, part, old, 'release' from seen where old is not null and old is distinct from instance_id""",
    ),
    "lease_key": _with(
        ["lease_offers"],
        f"""select event_id, case event_id % 5 when 0 then 'routes:live' when 1 then '{DEFAULT_PREFIX}' when 2 then 'routes'
  when 3 then '{DEFAULT_PREFIX}' else 'a:' end || ':' || topic || ':' || consumer_group || ':partition:' || part as lease_key from lease_offers""",
    ),
    "lease_valid": "select event_id, event_id % 47 <> 0 and event_id % 53 <> 0 and "
    + f"case event_id % {len(URL_CASES)} "
    + " ".join(f"when {i} then {str(ok).lower()}" for i, (_, ok) in enumerate(URL_CASES))
    + " end as valid from events",
    "route_lookup": _with(
        ["lease_log"],
        """marked as (
  select *, count(*) filter (kind = 'register') over w as epoch from lease_log window w as (partition by part order by t_us, event_id)
), current as (
  select m.*, r.t_us as reg_t, r.token as reg_token, r.gateway_id as reg_gateway, r.websocket_url as reg_url, r.t_us + r.ttl_us as ends
  from marked m left join marked r on r.part = m.part and r.epoch = m.epoch and r.kind = 'register'
), ended as (
  select *, min(case when kind = 'release' and token = reg_token then t_us end)
    over (partition by part, epoch order by t_us, event_id rows between unbounded preceding and 1 preceding) as released_t from current
), judged as (
  select *, case when epoch = 0 then 'never' when released_t < ends then 'released' when t_us >= ends then 'expired' else 'live' end as status
  from ended where kind = 'resolve'
)""",
        """select event_id, t_us, part, status, case when status = 'live' then reg_gateway end as gateway_id,
  case when status = 'live' then reg_url end as websocket_url from judged""",
    ),
    "echo_parse": _with(["received_echo"], _ECHO, "select *, received_ns - sent_ns as latency_ns from echoes"),
    "first_echo": _with(["received_echo"], _ECHO, "select * from firsts"),
    "sent_delivery": _with(
        ["sent", "received_echo"], _ECHO,
        """select s.event_id, s.user_id, coalesce(f.copies, 0) as copies, f.latency_ns
from sent s left join firsts f on f.user_id = s.user_id and f.content = s.content""",
    ),
    "delivery_report": _with(
        ["sent", "received_echo", "client_errors"], _ECHO,
        """select (select count(*) from sent) as sent, (select count(*) from received_echo) as received,
  (select count(distinct content) from echoes) as self_delivered,
  (select count(*) - count(distinct content) from echoes) as duplicates, (select max(latency_ns) from firsts) as max_latency_ns,
  (select count(*) filter (kind = 'write') from client_errors) as write_errors,
  (select count(*) filter (kind = 'read') from client_errors) as read_errors,
  cast((select count(distinct content) from echoes) as double) / (select count(*) from sent) * 100 as delivery_rate""",
    ),
    "latency_percentiles": _with(["received_echo"], _ECHO, _percentiles()),
    "latency_percentiles_by_user": _with(["received_echo"], _ECHO, _percentiles("user_id")),
    "latency_histogram": _with(["timings"], _HISTOGRAM, "select metric, labels, cast(value as double) as value from samples"),
    "connections_gauge": _with(
        ["membership_log"], _INTERVALS, _CHANGES,
        "select event_id, t_us, delta, cast(sum(delta) over (order by t_us, event_id) as bigint) as connections from changes",
    ),
    "connections_peak": _with(
        ["membership_log"], _INTERVALS, _CHANGES,
        """select cast(max(c) as bigint) as peak, cast(sum(delta) as bigint) as current, count(*) filter (delta > 0) as opened
from (select *, sum(delta) over (order by t_us, event_id) as c from changes)""",
    ),
    "connection_durations": _with(
        ["membership_log"], _INTERVALS, "select room_id, user_id, join_id, left_at - joined_at as duration_us from intervals where left_at is not null"
    ),
    "consumer_state": _with(
        ["consumer_log"],
        """select instance_id, max(case when kind = 'running' then 1 else 0 end) as running,
  coalesce(arg_max(case when kind = 'ready' then 1 else 0 end, t_us) filter (kind in ('ready', 'not_ready', 'restart')), 0) as ready,
  count(*) filter (kind = 'restart') as restarts from consumer_log group by instance_id""",
    ),
    "access_log": """select event_id, 'GET' as method, '/' || event_type as path,
  case event_type when 'error' then 500 when 'purchase' then 404 when 'signup' then 201 else 200 end as status,
  value as latency_ms, '10.' || user_id % 7 || '.0.' || event_id % 250 as client_ip,
  case event_type when 'error' then 'error' when 'purchase' then 'warn' else 'info' end as level from events""",
    "access_summary": """select level, 'GET' as method, path, status, count(*) as requests, cast(sum(cast(value as decimal(18,3))) as double) as latency_ms,
  max(value) as max_latency_ms
from (select value, '/' || event_type as path, case event_type when 'error' then 500 when 'purchase' then 404 when 'signup' then 201 else 200 end as status,
  case event_type when 'error' then 'error' when 'purchase' then 'warn' else 'info' end as level from events) group by level, path, status""",
    "liveness_timeouts": _with(
        ["pongs"],
        f"""select conn_id, event_id, t_us as last_us, t_us + {Q.SILENCE_US} as timed_out_us from (
  select *, lead(t_us) over (partition by conn_id order by t_us, event_id) as heard from pongs) where heard - t_us > {Q.SILENCE_US}""",
    ),
}

_STATE = """states as (
  select instance_id, max(case when kind = 'running' then 1 else 0 end) as running,
    coalesce(arg_max(case when kind = 'ready' then 1 else 0 end, t_us) filter (kind in ('ready', 'not_ready', 'restart')), 0) as ready,
    count(*) filter (kind = 'restart') as restarts from consumer_log group by instance_id
)"""
ORACLE["metrics_scrape"] = _with(
    ["frames", "consumers", "timings", "membership_log", "messages", "consumer_log", "receipts"],
    *_CHECKED, _COUNTERS, _HISTOGRAM, _INTERVALS, _CHANGES, _NUMBERED, _DELIVERIES, _MISSED, _STATE,
    """select metric, labels, cast(value as double) as value from (
  select metric, labels, cast(value as double) as value from counters union all select metric, labels, cast(value as double) from samples
  union all select 'chatstream_room_client_messages_dropped_total', '', (select count(*) from missed)
  union all select 'chatstream_websocket_connections_current', '', (select sum(delta) from changes)
  union all select 'chatstream_consumer_running', 'instance_id="' || instance_id || '"', running from states
  union all select 'chatstream_consumer_ready', 'instance_id="' || instance_id || '"', ready from states
  union all select 'chatstream_consumer_restarts_total', 'instance_id="' || instance_id || '"', restarts from states)""",
    recursive=True,
)

# Streams must give what their batch forms give.
ORACLE |= {
    "stream_histogram": _with(
        ["timings"],
        "select t_us - t_us % 86400000000 as from_us, "
        + ", ".join(f"count(*) filter (seconds <= {b}) as le_{i}" for i, b in enumerate(S.LATENCY_BUCKETS))
        + ", count(*) as n, cast(sum(cast(seconds as decimal(28,9))) as double) as total from timings group by 1",
    ),
    "stream_ingest": """select cast(((user_id + event_id) % 10) % 3 as int) as part, event_id as off,
  case when kind is null then 'valid' else 'poison' end as record_class,
  case when kind in ('not-json', 'number') then 'malformed' when kind is not null then 'invalid' end as error_class,
  case kind when 'user' then 'empty_user_id' when 'content' then 'empty_content' when 'created' then 'empty_created_at' end as invalid_code,
  case when kind is null then 'm-' || event_id when kind = 'user' then 'poison' when kind in ('content', 'created') then 'm' end as message_id,
  case when kind is null then 'room-' || (user_id + event_id) % 10 when kind = 'user' then 'room-1' when kind in ('content', 'created') then 'r' end as room_id
from (select *, case when event_id % 101 = 0 then 'not-json' when event_id % 103 = 0 then 'user' when event_id % 107 = 0 then 'number'
  when event_id % 109 = 0 then 'content' when event_id % 113 = 0 then 'created' end as kind from events)""",
    "stream_rate_limit": ORACLE["rate_limit"],
    "stream_sequence": _with(["arrived"], "select room_id, event_id, row_number() over (partition by room_id order by arrived_us, event_id) as sequence from arrived"),
    "stream_rooms": _with(["membership_log", "arrived"], _INTERVALS, _ARRIVED, _DELIVERIES, "select room_id, event_id, sequence, content, member_id from deliveries"),
    "stream_fanout": _with(["membership_log", "arrived"], _INTERVALS, _ARRIVED, _DELIVERIES, "select room_id, event_id, sequence, member_id from deliveries"),
    "stream_leases": ORACLE["route_lookup"],
    "stream_liveness": _with(
        ["pongs"],
        f"""select conn_id, event_id, t_us as last_us, t_us + {Q.SILENCE_US} as timed_out_us from (
  select *, lead(t_us) over (partition by conn_id order by t_us, event_id) as heard from pongs) where heard is null or heard - t_us > {Q.SILENCE_US}""",
    ),
    "stream_dedup": "select event_id, 'm-' || event_id as message_id from events",
    "stream_echo": _with(
        ["sent", "received_echo"], _ECHO,
        """select s.event_id, s.user_id, e.received_ns - e.sent_ns as latency_ns from sent s join echoes e on e.user_id = s.user_id and e.content = s.content""",
    ),
    "stream_metrics": _with(
        ["frames", "consumers"], *_CHECKED,
        """select t_us - t_us % 60000000 as from_us, coalesce(reject_reason, 'accepted') as reason, count(*) as frames from checked group by all""",
        recursive=True,
    ),
}

_FLOW = [
    *_CHECKED, _LOG, _INTERVALS.replace("membership_log", "connections"),
    f"""numbered as (
  select *, row_number() over (partition by room_id order by off) as sequence
  from log m where exists (select 1 from intervals i where {_PRESENT})
)""", _DELIVERIES,
]
ORACLE["flow_log"] = _with(
    ["frames", "consumers"], *_CHECKED, _LOG, "select part, off, message_id, room_id, user_id, content, t_us as created_us from log", recursive=True
)
ORACLE["flow_deliveries"] = _with(
    ["frames", "consumers", "connections"], *_FLOW, "select part, off, message_id, room_id, sequence, content, member_id from deliveries", recursive=True
)
ORACLE["log_export"] = _with(
    ["bus_log"], "select part, count(*) as records, min(off) as first_off, max(off) as last_off, 0 as out_of_order from bus_log group by part"
)

#: A row is late if an earlier batch held a time more than an hour after its own.
ORACLE["stream_late"] = _with(
    ["limiter_events"],
    """batched as (
  select *, least(3, date_diff('day', timestamp '2024-01-01', make_timestamp(t_us)) // 10 + case when event_id % 13 = 0 then 1 else 0 end) as batch from limiter_events
), seen as (select b.batch, (select max(t_us) // 1000 from batched e where e.batch < b.batch) - 3600000 as watermark from (select distinct batch from batched) b
), marked as (select b.*, coalesce(t_us <= greatest(watermark, 0) * 1000, false) as late from batched b join seen using (batch)
), heard as (select user_id, event_id, t_us from marked where not late)""",
    _bucket("heard", "t_us, event_id", f"{float(Q.LIMIT_RATE)!r}", Q.LIMIT_BURST),
    """select m.event_id, m.late, b.allowed from marked m left join ordered o on o.event_id = m.event_id
left join bucket b on b.user_id = o.user_id and b.rn = o.rn""",
    recursive=True,
)

_ROUTES = """marked as (
  select *, count(*) filter (kind = 'register') over w as epoch from line window w as (partition by part order by t_us, event_id)
), current as (
  select m.*, r.t_us as reg_t, r.token as reg_token, r.gateway_id as reg_gateway, r.websocket_url as reg_url, r.t_us + r.ttl_us as ends
  from marked m left join marked r on r.part = m.part and r.epoch = m.epoch and r.kind = 'register'
), ended as (
  select *, min(case when kind = 'release' and token = reg_token then t_us end)
    over (partition by part, epoch order by t_us, event_id rows between unbounded preceding and 1 preceding) as released_t from current
), judged as (
  select *, case when room = '' then 400 when epoch > 0 and (released_t is null or released_t >= ends) and t_us < ends then 200 else 503 end as http_status
  from ended where kind = 'resolve'
)"""
ORACLE["route_by_room"] = _with(
    ["lease_log", "route_requests"],
    f"""asked as (select event_id, t_us, trim(room_id, ' ' || chr(9)) as room from route_requests)
, line as (
  select event_id, t_us, part, gateway_id, websocket_url, token, ttl_us, kind, null as room from lease_log where kind <> 'resolve'
  union all select event_id, t_us, case when room <> '' then {_part('room')} end, null, null, null, null, 'resolve', room from asked
)""",
    _ROUTES,
    """select event_id, t_us, room as room_id, http_status, case when http_status = 200 then part end as partition,
  case when http_status = 200 then reg_gateway end as gateway_id, case when http_status = 200 then reg_url end as websocket_url from judged""",
)
ORACLE["stream_resume"] = f"""select part, off, record_class, case when record_class = 'valid' then 1 else 0 end as handled
from ({ORACLE['stream_ingest']})"""
