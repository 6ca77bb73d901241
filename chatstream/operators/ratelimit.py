"""Token bucket per user, in event time.

Arithmetic is exact. With rate = p/q tokens per second, time is counted in units
of 1/(p * 10^6) s, so one token takes q * 10^6 units and every quantity is an
integer. A bucket is then a single number, the instant ``full_at`` at which it
is full again: an event at ``u`` passes iff ``full_at - u <= (burst - 1) * token``
and moves it to ``max(u, full_at) + token``. A refused event changes nothing.
Floating-point buckets give the same answers except where rounding decides
whether a refill reaches a whole token, an error far below the microsecond to
which input times are cut anyway.

Rows are shuffled by user, sorted, and streamed through one pass that keeps
only the current bucket. A user who holds a large share of all rows is cut into
time slices. A slice does not know the bucket it starts with, so a first pass
describes each slice as a function from ``full_at`` before to ``full_at`` after
(a few linear pieces, see ``SliceEffect``), the functions are
chained per user, and the second pass runs all slices in parallel, each from
its own exact starting bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatstream.operators.ordered import HOT, Spread, cut
from chatstream.schema import DEFAULT_BURST, DEFAULT_RATE

#: Stands for "full since ever"; far below any real instant.
_FULL = -(10**60)


def bucket_units(rate, burst: int) -> tuple[int, int]:
    """(units per microsecond, units per token). Raises on a rate or burst that is not positive."""
    exact = Fraction(str(rate)) if isinstance(rate, float) else Fraction(rate)
    if exact <= 0:
        raise ValueError("rate must be greater than zero")
    if burst <= 0:
        raise ValueError("burst must be greater than zero")
    return exact.numerator, exact.denominator * 1_000_000


def take(full_at: int, u: int, token: int, slack: int) -> tuple[bool, int]:
    """One event: does it pass, and when is the bucket full afterwards."""
    if full_at - u > slack:
        return False, full_at
    return True, (u if u > full_at else full_at) + token


class SliceEffect:
    """What a run of events does to ``full_at``, as linear pieces of the input.

    A piece is (least outcome, low, high, shift, fixed): inputs in low..high come
    out as input + shift, or as ``fixed`` when that is not None. Pieces wait in a
    heap by their least outcome, so an event touches only those it lets through.

    With a burst of two or more there are few pieces. With a burst of one every
    event of the first token time can be a piece of its own; each is then
    touched once per token time.
    """

    def __init__(self, first_u: int, token: int, slack: int) -> None:
        # no event up to the first one can have left the bucket emptier than this
        self._heap: list[tuple] = [(_FULL, _FULL, first_u + slack + token, 0, None)]
        self._compact_at = 16
        self._only: int | None = None  # the outcome, once every starting bucket leads to the same one
        self.domain = (_FULL, first_u + slack + token)
        self.token, self.slack = token, slack

    @property
    def pieces(self) -> list[tuple]:
        """(low, high, shift, fixed) in input order."""
        if self._only is not None:
            return [(*self.domain, 0, self._only)]
        return [p[1:] for p in self._merged(self._heap)]

    def add(self, u: int) -> None:
        limit = u + self.slack
        if self._only is not None:
            if self._only <= limit:
                self._only = (u if u > self._only else self._only) + self.token
            return
        heap, token = self._heap, self.token
        if heap[0][0] > limit:
            return  # refused from every starting bucket
        out: list[tuple] = []
        while heap and heap[0][0] <= limit:
            least, low, high, shift, fixed = heappop(heap)
            if fixed is not None:
                after = max(u, fixed) + token
                out.append((after, low, high, 0, after))
                continue
            refilled, passing = u - shift, limit - shift
            if low <= refilled:
                out.append((u + token, low, min(high, refilled), 0, u + token))
            if high > refilled:
                start = max(low, refilled + 1)
                out.append((start + shift + token, start, min(high, passing), shift + token, None))
            if high > passing:
                out.append((passing + 1 + shift, passing + 1, high, shift, None))
        if not heap or len(heap) + len(out) > self._compact_at:
            out = self._merged([*heap, *out])
            heap.clear()
            self._compact_at = 2 * len(out) + 16
            if len(out) == 1:
                self._only = out[0][4]
        for piece in out:
            heappush(heap, piece)

    @staticmethod
    def _merged(pieces: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for least, low, high, shift, fixed in sorted(pieces, key=lambda p: p[1]):
            if out and out[-1][3] == shift and out[-1][4] == fixed:
                out[-1] = (out[-1][0], out[-1][1], high, shift, fixed)
            else:
                out.append((least, low, high, shift, fixed))
        return out

    @staticmethod
    def apply(pieces, full_at: int) -> int:
        for low, high, shift, fixed in pieces:
            if low <= full_at <= high:
                return fixed if fixed is not None else full_at + shift
        raise ValueError("bucket state outside the domain")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of rows with the same (_user, _slice): key, first row, row after the last."""
    user, part = batch.column("_user"), batch.column("_slice")
    n = batch.num_rows
    if n == 0:
        return
    same = pc.and_(
        pc.equal(user.slice(1), user.slice(0, n - 1)),
        pc.equal(pc.fill_null(part, -1).slice(1), pc.fill_null(part, -1).slice(0, n - 1)),
    )
    starts = [0, *(np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for first, end in zip(starts, starts[1:]):
        yield (user[first].as_py(), part[first].as_py()), first, end


_CELL = ["_user", "_slice"]
_PIECE = ("low", "high", "shift", "fixed")
_EFFECT = f"_user string, _slice bigint, pieces array<struct<{', '.join(f'{p}: string' for p in _PIECE)}>>"


def _slice_effects(per_us: int, token: int, slack: int):
    pieces_type = pa.list_(pa.struct([(p, pa.string()) for p in _PIECE]))

    def emit(key, effect):
        # integers beyond 64 bits: a rate may have any numerator
        pieces = [{n: None if v is None else str(v) for n, v in zip(_PIECE, p)} for p in effect.pieces]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([pieces], pieces_type)],
            names=[*_CELL, "pieces"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, effect = None, None
        for batch in batches:
            times = batch.column("t_us").to_pylist()
            for run_key, first, end in _runs(batch):
                if run_key != key:
                    if key is not None:
                        yield emit(key, effect)
                    key, effect = run_key, SliceEffect(times[first] * per_us, token, slack)
                add = effect.add
                for t in times[first:end]:
                    add(t * per_us)
        if key is not None:
            yield emit(key, effect)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of each user in time order -> the bucket each one starts with."""
    user, full_at = None, _FULL
    for batch in batches:
        rows = batch.to_pydict()
        starts = []
        for u, pieces in zip(rows["_user"], rows["pieces"]):
            if u != user:
                user, full_at = u, _FULL
            starts.append(str(full_at))
            full_at = SliceEffect.apply([tuple(None if p[n] is None else int(p[n]) for n in _PIECE) for p in pieces], full_at)
        yield pa.RecordBatch.from_arrays(
            [batch.column("_user"), batch.column("_slice"), pa.array(starts, pa.string())], names=[*_CELL, "_start"]
        )


def _decide(per_us: int, token: int, slack: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, full_at = None, _FULL
        for batch in batches:
            times = batch.column("t_us").to_pylist()
            charged = batch.column("_charge").to_pylist()
            start = batch.column("_start")
            verdicts = []
            for run_key, first, end in _runs(batch):
                if run_key != key:
                    carried = start[first].as_py()
                    key, full_at = run_key, (_FULL if carried is None else int(carried))
                for t, charge in zip(times[first:end], charged[first:end]):
                    if not charge:
                        verdicts.append(None)
                        continue
                    u = t * per_us
                    if full_at - u > slack:
                        verdicts.append(False)
                    else:
                        verdicts.append(True)
                        full_at = (u if u > full_at else full_at) + token
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(verdicts, pa.bool_())], names=[*kept, "allowed"]
            )

    return run


def _starts(cut_rows: DataFrame, per_us: int, token: int, slack: int, tie: str) -> DataFrame:
    """The bucket that every slice of a cut user starts with."""
    effects = (
        cut_rows.where(F.col("_charge"))
        .select(*_CELL, "t_us", tie)
        .repartition(*_CELL)
        .sortWithinPartitions(*_CELL, "t_us", tie)
        .mapInArrow(_slice_effects(per_us, token, slack), _EFFECT)
    )
    return (
        effects.repartition("_user")
        .sortWithinPartitions(*_CELL)
        .mapInArrow(_chain, "_user string, _slice bigint, _start string")
    )


def rate_limit(
    events: DataFrame,
    rate=DEFAULT_RATE,
    burst: int = DEFAULT_BURST,
    tie: str = "event_id",
    charge: Column | None = None,
    per: str | None = None,
    spread: Spread = HOT,
) -> DataFrame:
    """Add ``allowed`` to rows with ``user_id``, ``t_us`` and an order column ``tie``.

    ``rate`` may be an int, a Fraction, a decimal string or a float (read as its
    decimal text). Rows for which ``charge`` is not true neither ask for nor use
    a token and get NULL. An empty user id is never allowed. A user has one
    bucket, or one for each value of the column ``per`` (say, the gateway).
    """
    per_us, token = bucket_units(rate, burst)
    slack = (burst - 1) * token
    asks = F.lit(True) if charge is None else F.coalesce(charge, F.lit(False))
    user = F.coalesce("user_id", F.lit(""))
    bucket = user if per is None else F.concat_ws("\x1f", F.col(per).cast("string"), user)
    keyed = events.withColumn("_user", bucket).withColumn("_charge", asks & (user != ""))

    sliced, cut_rows = cut(keyed, ["_user"], "t_us", spread)
    if cut_rows is None:
        started = sliced.withColumn("_start", F.lit(None).cast("string")).repartition("_user")
    else:
        started = sliced.repartition(*_CELL).join(_starts(cut_rows, per_us, token, slack, tie), _CELL, "left")
    # The pass relies on the repartition above to see a bucket's rows together; the join keeps it.
    schema = T.StructType([*events.schema.fields, T.StructField("allowed", T.BooleanType())])
    return (
        started.sortWithinPartitions(*_CELL, "t_us", tie)
        .mapInArrow(_decide(per_us, token, slack, events.columns), schema)
        .withColumn("allowed", F.when(asks, F.coalesce("allowed", F.lit(False))))
    )


def limit_frames(moderated: DataFrame, rate=DEFAULT_RATE, burst: int = DEFAULT_BURST, spread: Spread = HOT) -> DataFrame:
    """Charge a token for every frame the checks let through; refused ones get ``rate_limit``."""
    limited = rate_limit(
        moderated.withColumn("_tie", F.struct("conn_id", "frame_no")),
        rate,
        burst,
        tie="_tie",
        charge=F.col("reject_reason").isNull(),
        spread=spread,
    )
    return limited.withColumn(
        "reject_reason", F.when(~F.col("allowed"), F.lit("rate_limit")).otherwise(F.col("reject_reason"))
    ).select(*moderated.columns)
