"""Record types, limits and the bounded dimensions shared by all operators."""

from __future__ import annotations

ENVELOPE = (
    "message_id string, room_id string, user_id string, content string, "
    "sequence decimal(20,0), created_at timestamp"
)
BUS_RECORD = "topic string, part int, off bigint, key string, value string"
FRAME = "conn_id bigint, frame_no bigint, room_id string, user_id string, t_us bigint, payload string"

# --- fixed values the results depend on -------------------------------------
MAX_FRAME_BYTES = 4096
MAX_CONTENT_CHARS = 500
DEFAULT_RATE = 5
DEFAULT_BURST = 10
PONG_TIMEOUT_US = 60_000_000
DEFAULT_DICTIONARY = ["赌博", "诈骗"]
ECHO_PREFIX = "loadtest"
LATENCY_BUCKETS = ["0.005", "0.01", "0.025", "0.05", "0.1", "0.25", "0.5", "1", "2.5", "5", "10"]

#: reason, wire code, wire message, what happens to the connection
REASONS = [
    ("frame_too_large", None, None, "close"),
    ("invalid_json", "invalid_json", "message must be valid JSON", "close"),
    ("empty_content", "empty_content", "content cannot be empty", "keep"),
    ("content_too_long", "content_too_long", "content is too long", "keep"),
    ("sensitive_content", "sensitive_content", "message contains sensitive content", "keep"),
    ("rate_limit", None, None, "silent"),
    ("message_bus_unavailable", "message_bus_unavailable", "message queue is temporarily unavailable", "keep"),
    ("message_id_generation_failed", "message_bus_unavailable", "message queue is temporarily unavailable", "keep"),
]
TERMINAL_REASONS = ["frame_too_large", "invalid_json"]
# -----------------------------------------------------------------------------

HOUR_US = 3_600_000_000
