"""Chat inputs derived from the generated tables.

Each view is one portable SQL text; three macros and the table names are the
only parts that differ between engines:

    @US(x)    microseconds since the epoch of a timestamp
    @JSON(x)  the text of the object {"content": x}
    @RFC(x)   RFC 3339 text of a timestamp
    @STR      the string type
    @PARTS    a join that repeats every row for partitions 0, 1 and 2 as p.part
    @T(name)  a table
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: (payload expression over ``txt``, reason the frame is refused with; None = accepted)
JSON_CASES: list[tuple[str, str | None]] = [
    ("@JSON(txt)", None),
    ("' ' || @JSON(txt) || ' ' || chr(10)", None),
    ("""'{"Content":"' || txt || '"}'""", None),
    ("""'{"CONTENT":null,"content":"' || txt || '"}'""", None),
    ("""'{"content":"a","content":"' || txt || '"}'""", None),
    ("""'{"other":{"content":1},"content":"' || txt || '"}'""", None),
    ("'null'", "empty_content"),
    ("'{}'", "empty_content"),
    ("""'{"content":null}'""", "empty_content"),
    ("""'{"content":"   "}'""", "empty_content"),
    ("""'{"content":"' || chr(92) || 't"}'""", "empty_content"),
    ("@JSON('\u3000\u0085')", "empty_content"),
    ("@JSON(repeat('a', 500))", None),
    ("@JSON(repeat('a', 501))", "content_too_long"),
    ("@JSON(repeat('赌', 500))", None),
    ("@JSON(txt) || ' trailing'", "invalid_json"),
    ("@JSON(txt) || ',' || @JSON(txt)", "invalid_json"),
    ("@JSON(txt) || '],[' || @JSON(txt)", "invalid_json"),
    ("@JSON(txt) || '},{'", "invalid_json"),
    ("'{' || chr(39) || 'content' || chr(39) || ':' || chr(39) || txt || chr(39) || '}'", "invalid_json"),
    ("""'{"content":"' || txt || '",}'""", "invalid_json"),
    ("""'{"content":5}'""", "invalid_json"),
    ("""'{"content":{"a":1}}'""", "invalid_json"),
    ("""'{"content":5,"content":"' || txt || '"}'""", "invalid_json"),
    ("'[]'", "invalid_json"),
    ("""'"s"'""", "invalid_json"),
    ("''", "invalid_json"),
    ("repeat('x', 4097)", "frame_too_large"),
    ("'{}' || repeat(' ', 4094)", "empty_content"),
]

#: Cases beyond the usual reader limits, one in so many rows each.
RARE_CASES: list[tuple[str, str | None]] = [
    ("""'{"deep":' || repeat('[', 1500) || repeat(']', 1500) || ',"content":"' || txt || '"}'""", None),
    ("""'{"long":' || repeat('7', 1200) || ',"content":"' || txt || '"}'""", None),
    ("""'{"content":' || repeat('7', 1200) || '}'""", "invalid_json"),
]
RARE = 499

#: (address, is it acceptable)
URL_CASES: list[tuple[str, bool]] = [
    ("wss://eu-3.chat.test:8443/room/socket", True),
    ("ws://[2001:db8::7]:81/", True),
    ("WSS://Upper.Test", True),
    ("wss://host.test/a%20b;v=1/../c", True),
    ("ftp://files.test/socket", False),
    ("wss://@host.test/", False),
    ("wss://name:@host.test/", False),
    ("ws://host.test/?", True),
    ("ws://host.test/p?x#y", False),
    ("ws:host.test", False),
    ("//host.test/socket", False),
    ("wss://:443/socket", True),
    ("  ", False),
]


def _json_payload() -> str:
    arms = "\n".join(f"      when {i} then {payload}" for i, (payload, _) in enumerate(JSON_CASES))
    rare = "\n".join(f"      when event_id % {RARE} = {i} then {payload}" for i, (payload, _) in enumerate(RARE_CASES))
    return f"case\n{rare}\n    else case event_id % {len(JSON_CASES)}\n{arms}\n    end end"


def _url() -> str:
    arms = " ".join(f"when {i} then '{url}'" for i, (url, _) in enumerate(URL_CASES))
    return f"case event_id % {len(URL_CASES)} {arms} end"


VIEWS: dict[str, str] = {
    "frames": """
select conv_id as conn_id, turn as frame_no,
  'room-' || cast(conv_id % 10 as @STR) as room_id, 'user-' || cast(conv_id % 37 as @STR) as user_id,
  1704067200000000 + conv_id * 1000000 + turn * 50000 as t_us,
  case when (conv_id * 7 + turn) % 23 = 0 then 'not-json'
       when (conv_id * 5 + turn) % 29 = 0 then '{"content":"   "}'
       when (conv_id * 3 + turn) % 31 = 0 then '{"content":5}'
       when (conv_id * 11 + turn) % 37 = 0 then @JSON(repeat(text, 40))
       else @JSON(text) end as payload,
  cast(conv_id % 4 as int) as instance_id, (conv_id * 13 + turn) % 41 = 0 as id_failed, (conv_id * 17 + turn) % 43 = 0 as write_failed
from @T(conversations)""",
    "consumers": """
select conv_id as event_id, 1704067200000000 + conv_id * 1000000 + 20000 as t_us, cast(conv_id * 3 % 4 as int) as instance_id,
  case when conv_id % 6 = 5 then 'not_ready' when conv_id % 6 = 2 then 'restart' else 'ready' end as kind
from @T(conversations) where turn = 0""",
    "connections": """
select conv_id * 2 as event_id, 1704067200000000 + conv_id * 1000000 - 500000 as t_us, 'room-' || cast(conv_id % 10 as @STR) as room_id,
  'user-' || cast(conv_id % 37 as @STR) as user_id, 'join' as kind
from @T(conversations) where turn = 0 and conv_id % 9 <> 1
union all
select conv_id * 2 + 1, 1704067200000000 + conv_id * 1000000 + 15000000, 'room-' || cast(conv_id % 10 as @STR), 'user-' || cast(conv_id % 37 as @STR), 'leave'
from @T(conversations) where turn = 0 and conv_id % 3 = 0""",
    "json_cases": f"""
select event_id as conn_id, 0 as frame_no, 'room-1' as room_id, 'user-' || cast(user_id as @STR) as user_id,
  @US(ts) as t_us, {_json_payload()} as payload
from (select event_id, user_id, ts, event_type || '-' || cast(event_id as @STR) as txt from @T(events)) e""",
    "messages": """
select event_id, @US(ts) as t_us, 'room-' || cast((user_id + event_id) % 10 as @STR) as room_id,
  'user-' || cast(user_id as @STR) as user_id, event_type || '-' || cast(event_id as @STR) as content,
  cast(((user_id + event_id) % 10) % 3 as int) as part, event_id as off
from @T(events) where event_type in ('click', 'view', 'purchase')""",
    "arrived": """
select event_id, @US(ts) as t_us, @US(ts) + (event_id * 7919 % 900) * 1000000 as arrived_us, 'room-' || cast((user_id + event_id) % 10 as @STR) as room_id,
  'user-' || cast(user_id as @STR) as user_id, event_type || '-' || cast(event_id as @STR) as content
from @T(events) where event_type in ('click', 'view', 'purchase')""",
    "bus_log": """
select 'chat' as topic, cast(((user_id + event_id) % 10) % 3 as int) as part, event_id as off,
  case when event_id % 101 = 0 then 'not-json'
       when event_id % 103 = 0 then '{"message_id":"poison","room_id":"room-1"}'
       when event_id % 107 = 0 then '{"message_id":7,"room_id":"room-1"}'
       when event_id % 109 = 0 then '{"message_id":"m","room_id":"r","user_id":"u","content":" ","created_at":"2024-01-01T00:00:00Z"}'
       when event_id % 113 = 0 then '{"message_id":"m","room_id":"r","user_id":"u","content":"c"}'
       else '{"message_id":"m-' || cast(event_id as @STR) || '","room_id":"room-' || cast((user_id + event_id) % 10 as @STR)
         || '","user_id":"user-' || cast(user_id as @STR) || '","content":"' || event_type
         || '","sequence":0,"created_at":"' || @RFC(ts) || '"}' end as value
from @T(events)""",
    "envelopes": """
select case when event_id % 11 = 0 then ' ' else 'm-' || cast(event_id as @STR) end as message_id,
  case when event_id % 13 = 0 then '' else 'room-' || cast(user_id % 10 as @STR) end as room_id,
  case when event_id % 17 = 0 then chr(9) else 'user-' || cast(user_id as @STR) end as user_id,
  case when event_id % 19 = 0 then null else event_type end as content,
  case when event_id % 23 = 0 then null else ts end as created_at, event_id, ts as received_at
from @T(events)""",
    "limiter_events": """
select cast(user_id as @STR) as user_id, event_id, @US(ts) as t_us from @T(events)""",
    "membership_log": """
select event_id, @US(ts) as t_us, 'room-' || cast(user_id % 10 as @STR) as room_id,
  'user-' || cast(user_id as @STR) as user_id,
  case event_type when 'signup' then 'join' else 'leave' end as kind
from @T(events) where event_type in ('signup', 'error')""",
    "receipts": """
select e.event_id, 'user-' || cast((e.user_id + e.event_id) % 10 + 10 * p.part as @STR) as member_id
from @T(events) e @PARTS where e.event_type in ('click', 'view', 'purchase') and (e.event_id + p.part) % 17 <> 0""",
    "arrivals": """
select event_id, 'room-' || cast((user_id + event_id) % 10 as @STR) as room_id, event_id as off,
  @US(ts) + cast(floor(value * 60000000) as bigint) as t_us
from @T(events)""",
    "ownership_log": """
select e.event_id, @US(e.ts) as t_us, p.part as part,
  case when e.user_id % 10 = 0 then null else cast((p.part + e.event_id) % 2 as int) end as instance_id
from @T(events) e @PARTS where e.event_type = 'error'""",
    "topic_partitions": """
select e.event_id, p.part as part from @T(events) e @PARTS where e.event_type = 'error'""",
    "assigned_log": """
select event_id, @US(ts) as t_us, cast(user_id % 4 as int) as part, cast(event_id % 2 as int) as instance_id
from @T(events) where event_type = 'error'""",
    "claims": """
select event_id, part, instance_id from (
  select e.event_id, e.user_id, p.part as part, cast((p.part + e.event_id) % 2 as int) as instance_id
  from @T(events) e @PARTS where e.event_type = 'error'
  union all
  select e.event_id, e.user_id, p.part as part, cast(0 as int) as instance_id
  from @T(events) e @PARTS where e.event_type = 'error' and e.user_id % 5 = 0
) c where not (user_id % 7 = 0 and part = 1)""",
    "handshakes": """
select event_id, @US(ts) as t_us, @US(ts) + cast(floor(value * 60000000) as bigint) as registered_us,
  case when user_id % 41 = 0 then '  ' else ' user-' || cast(user_id as @STR) end as user_id,
  case when event_id % 43 = 0 then chr(9) else 'room-' || cast((user_id + event_id) % 10 as @STR) || ' ' end as room_id,
  event_type <> 'error' as ready, cast(event_id % 2 as int) as gateway
from @T(events)""",
    "lease_log": """
select event_id, @US(ts) as t_us, cast(user_id % 3 as int) as part,
  'gw-' || cast(event_id % 4 as @STR) as gateway_id, 'wss://gw-' || cast(event_id % 4 as @STR) || '.example/ws' as websocket_url,
  'token-' || cast(event_id % 4 as @STR) as token, cast(1800000000 as bigint) as ttl_us,
  case event_type when 'signup' then 'register' when 'error' then 'release' else 'resolve' end as kind
from @T(events) where event_type in ('signup', 'error', 'view')""",
    "route_requests": """
select event_id, @US(ts) as t_us, case when event_id % 43 = 0 then ' ' else ' room-' || cast((user_id + event_id) % 10 as @STR) || chr(9) end as room_id
from @T(events) where event_type in ('click', 'purchase')""",
    "lease_offers": f"""
select event_id, cast(user_id % 3 as int) as part, case when event_id % 47 = 0 then ' ' else 'gw-1' end as gateway_id,
  case when event_id % 53 = 0 then '' else 'token-1' end as token, {_url()} as websocket_url,
  case event_id % 5 when 0 then ' routes:live: ' when 1 then '' when 2 then 'routes' when 3 then ':' else 'a::' end as prefix,
  'topic-' || event_type as topic, 'group-' || cast(user_id % 5 as @STR) as consumer_group
from @T(events)""",
    "sent": """
select event_id, 'user-' || cast(user_id as @STR) as user_id, @US(ts) * 1000 as sent_ns,
  'loadtest:user-' || cast(user_id as @STR) || ':' || cast(@US(ts) * 1000 as @STR) as content
from @T(events) where event_type in ('click', 'view')""",
    "received_echo": """
select 'user-' || cast(user_id as @STR) as user_id,
  @US(ts) * 1000 + cast(floor(value * 1000000) as bigint) as received_ns,
  'loadtest:user-' || cast(user_id as @STR) || ':' || cast(@US(ts) * 1000 as @STR) as content
from @T(events) where event_type in ('click', 'view') and event_id % 20 <> 0
union all
select 'user-' || cast(user_id as @STR), @US(ts) * 1000 + cast(floor(value * 2000000) as bigint),
  'loadtest:user-' || cast(user_id as @STR) || ':' || cast(@US(ts) * 1000 as @STR)
from @T(events) where event_type in ('click', 'view') and event_id % 20 <> 0 and event_id % 7 = 0
union all
select 'user-' || cast(user_id as @STR), @US(ts) * 1000, case when event_id % 2 = 0 then 'hello' else 'loadtest:user-x:abc' end
from @T(events) where event_type in ('click', 'view') and event_id % 11 = 0""",
    "client_errors": """
select event_id, case when event_id % 3 = 0 then 'write' else 'read' end as kind from @T(events) where event_type = 'error'""",
    "timings": """
select event_id, @US(ts) as t_us, value / 10 as seconds, value / 128 as handler_seconds from @T(events)""",
    "attempts": """
select event_id, @US(ts) as t_us, cast(user_id as @STR) as user_id, cast((user_id + 1) % 4 as int) as instance_id,
  case when event_id % 97 <> 0 then 'm-' || cast(event_id as @STR) end as message_id, event_id % 89 <> 0 as published
from @T(events)""",
    "access_rows": """
select event_id, 'GET' as method, '/' || event_type || case when event_id % 3 = 0 then '?token=' || cast(event_id as @STR) else '' end as path,
  value as latency_ms, '10.' || cast(user_id % 7 as @STR) || '.0.' || cast(event_id % 250 as @STR) as client_ip,
  case event_type when 'error' then 500 when 'purchase' then 404 when 'signup' then 201 else 200 end as status
from @T(events)""",
    "pongs": """
select user_id % 50 as conn_id, event_id, @US(ts) as t_us from @T(events)""",
    "consumer_log": """
select event_id, @US(ts) as t_us, cast(user_id % 4 as int) as instance_id,
  case event_type when 'signup' then 'ready' when 'error' then 'restart' when 'purchase' then 'not_ready' else 'running' end as kind
from @T(events)""",
    "word_lists": """
select p_partkey, ' ' || upper(p_name) || chr(9) as first_word, '  ' as blank_word, p_type as last_word from @T(part)""",
}

_SPARK: dict[str, Callable[[str], str]] = {
    "@US": lambda x: f"unix_micros(cast({x} as timestamp))",
    "@JSON": lambda x: f"to_json(struct({x} as content))",
    "@RFC": lambda x: f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
}
_DUCKDB: dict[str, Callable[[str], str]] = {
    "@US": lambda x: f"epoch_us({x})",
    "@JSON": lambda x: f"cast(json_object('content', {x}) as varchar)",
    "@RFC": lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%fZ')",
    "@T": lambda x: x,
}


def _expand(sql: str, macros: dict[str, Callable[[str], str]]) -> str:
    for name, render in macros.items():
        while (at := sql.find(name + "(")) >= 0:
            depth, end = 0, at + len(name)
            while True:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
                if depth == 0:
                    break
            sql = sql[:at] + render(sql[at + len(name) + 1 : end - 1]) + sql[end:]
    return sql


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    macros = {**_SPARK, "@T": lambda table: f"parquet.`{sf_dir}/{table}.parquet`"}
    sql = VIEWS[name].replace("@PARTS", "lateral view explode(array(0, 1, 2)) p as part").replace("@STR", "string")
    return spark.sql(_expand(sql, macros))


def duckdb_view(name: str) -> str:
    sql = VIEWS[name].replace("@PARTS", "cross join (values (0), (1), (2)) p(part)").replace("@STR", "varchar")
    return f"{name} as ({_expand(sql, _DUCKDB)}\n)"
