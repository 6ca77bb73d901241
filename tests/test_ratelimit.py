import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatstream.operators.ordered import HOT, Spread
from chatstream.operators.ratelimit import _FULL, SliceEffect, bucket_units, limit_frames, rate_limit, take

S = 1_000_000
CUT = Spread(width_us=2 * S, mode="hot", hot_share=0, hot_min_rows=0)


def reference_bucket(times, rate, burst):
    """The textbook bucket in exact fractions."""
    tokens, last, out = None, None, []
    for t in times:
        tokens = Fraction(burst) if tokens is None else min(Fraction(burst), tokens + Fraction(t - last, S) * Fraction(str(rate)))
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out


def verdicts(spark, times, rate, burst, spread=HOT, user="u"):
    df = spark.createDataFrame([(user, t, i) for i, t in enumerate(times)], "user_id string, t_us long, event_id long")
    return [r.allowed for r in rate_limit(df, rate, burst, spread=spread).orderBy("event_id").collect()]


@pytest.mark.parametrize("spread", [HOT, CUT], ids=["whole", "cut"])
@pytest.mark.parametrize("rate, burst, times, want", [
    (1, 2, [0, 0, 0], [True, True, False]),
    (2, 1, [0, 0, 500_000], [True, False, True]),
    (2, 1, [0, 0, 499_999], [True, False, False]),
    (1, 10, [0] * 32, [True] * 10 + [False] * 22),
    (5, 10, [0] * 11, [True] * 10 + [False]),
    (0.5, 1, [0, 1 * S, 2 * S, 3 * S, 4 * S], [True, False, True, False, True]),
])
def test_bucket_cases(spark, rate, burst, times, want, spread):
    assert verdicts(spark, times, rate, burst, spread) == want


def test_users_are_independent_and_empty_is_refused(spark):
    data = [("alice", 0, 0), ("bob", 0, 1), ("alice", 0, 2), ("", 0, 3), (None, 0, 4)]
    df = spark.createDataFrame(data, "user_id string, t_us long, event_id long")
    got = {r.event_id: r.allowed for r in rate_limit(df, 1, 1).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("rate, burst", [(0, 1), (-1, 1), (1, 0), (1, -2)])
def test_bad_settings_raise(rate, burst):
    with pytest.raises(ValueError):
        bucket_units(rate, burst)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 6_000), min_size=1, max_size=60), st.sampled_from([(5, 10), (2, 1), (1, 3), (0.5, 2), (Fraction(1, 3), 2)]), st.integers(1, 3_000))
def test_slices_chain_to_the_sequential_result(ms, setting, width_ms):
    rate, burst = setting
    per_us, token = bucket_units(rate, burst)
    slack = (burst - 1) * token
    times = sorted(m * 1000 for m in ms)
    cells: dict[int, list[int]] = {}
    for t in times:
        cells.setdefault(t // (width_ms * 1000), []).append(t)
    full_at, got = _FULL, []
    for _, cell in sorted(cells.items()):
        effect, inner = SliceEffect(cell[0] * per_us, token, slack), full_at
        for t in cell:
            effect.add(t * per_us)
            passed, inner = take(inner, t * per_us, token, slack)
            got.append(passed)
        if burst > 1:
            assert len(effect.pieces) <= 3 * burst + 3
        full_at = SliceEffect.apply(effect.pieces, full_at)
        assert full_at == inner
    assert got == reference_bucket(times, rate, burst)


@pytest.mark.parametrize("spread", [HOT, Spread(width_us=7 * S, mode="hot", hot_share=0.4, hot_min_rows=10), CUT], ids=["whole", "hot user cut", "all cut"])
def test_skewed_users(spark, spread):
    rng = random.Random(3)
    data = [(rng.choice(["bot", "bot", "bot", "a", "b"]), rng.randrange(0, 400) * 250_000, i) for i in range(4000)]
    df = spark.createDataFrame(data, "user_id string, t_us long, event_id long")
    got = {r.event_id: r.allowed for r in rate_limit(df, 5, 10, spread=spread).collect()}
    assert len(got) == len(data)
    for user in {u for u, _, _ in data}:
        mine = sorted((t, i) for u, t, i in data if u == user)
        assert [got[i] for _, i in mine] == reference_bucket([t for t, _ in mine], 5, 10)


def test_rejected_frames_cost_no_token(spark):
    data = [(1, i, "u", i * 1000, "empty_content" if i % 2 else None) for i in range(6)]
    df = spark.createDataFrame(data, "conn_id long, frame_no long, user_id string, t_us long, reject_reason string")
    got = [r.reject_reason for r in limit_frames(df, 1, 2).orderBy("frame_no").collect()]
    assert got == [None, "empty_content", None, "empty_content", "rate_limit", "empty_content"]


@pytest.mark.parametrize("burst", [1, 2, 10])
def test_a_flood_stays_cheap(burst):
    """A hundred events per token time: pieces stay within one token time of events, and the result is exact."""
    per_us, token = bucket_units(5, burst)
    slack = (burst - 1) * token
    rng = random.Random(burst)
    times = sorted(rng.randrange(0, 20 * S) for _ in range(10_000))
    effect = SliceEffect(times[0] * per_us, token, slack)
    for t in times:
        effect.add(t * per_us)
    assert len(effect.pieces) <= (150 if burst == 1 else 3 * burst + 3)
    for start in [_FULL, times[0] * per_us + 1, times[0] * per_us + slack, times[0] * per_us + slack + token]:
        full_at = start
        for t in times:
            _, full_at = take(full_at, t * per_us, token, slack)
        assert SliceEffect.apply(effect.pieces, start) == full_at
