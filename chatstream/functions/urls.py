"""Checks on the public socket address of a gateway."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatstream.functions.text import is_blank


#: Scheme, host (a name, or an address in brackets), digits as port, a path without control characters and with whole
#: escapes; an empty query or fragment may be hinted at, user info may not.
SOCKET_URL = (
    r"(?i)\Awss?://(?=[^/?#])(?:\[[0-9a-z:.%~_-]++\]|[a-z0-9!$&'()*+,;=<>\"._~\x{80}-\x{10FFFF}-]*+)(?::[0-9]*+)?"
    r"(?:/(?:[^%?#\x00-\x1f\x7f]|%[0-9a-f]{2})*+)?\??#?\z"
)


def safe_socket_url(url: Column) -> Column:
    """ws or wss scheme, a host, and no user info, query or fragment."""
    return F.coalesce(url.rlike(SOCKET_URL), F.lit(False))


def valid_lease(gateway_id: Column, websocket_url: Column, token: Column) -> Column:
    return ~is_blank(gateway_id) & ~is_blank(token) & safe_socket_url(websocket_url)
