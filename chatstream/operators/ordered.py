"""Ordered per-key calculations that stay parallel when one key is huge.

A plain window puts all rows of a key into one task. Here a key's rows are cut
into time slices, the window runs inside (key, slice), and what earlier slices
contribute is carried in from a summary with one row per (key, slice):

    rows ──────────────── exchange (key, slice) ── local window ──┐
      └─ partial agg ── summary ── window over slices per key ────┴ join ── result

``spread="all"`` cuts every key; right where keys are few (rooms, partitions,
the whole system). ``spread="hot"`` cuts only keys that hold a large share of
the rows, found beforehand by a map-side-combined count, and leaves all other
keys in one piece, so that the usual rows are shuffled once and the carry only
exists when there is a hot key. At most ``1 / HOT_SHARE`` keys can hold that
share, which is the proven bound on what is collected and broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 20_000
HOT_MIN_ROWS = 1_000_000
SLICE_US = 300_000_000
ROWS_PER_SLICE = 2_000_000
MAX_SLICES = 100_000
_PIECES = 1 << 20
_LEVELS = 2


def floor_div(c: Column, width: int) -> Column:
    """Integer quotient rounded down, without a detour through doubles."""
    w = F.lit(width).cast("bigint")
    return F.call_function("div", c - F.pmod(c, w), w)


@dataclass(frozen=True)
class Spread:
    """How a key's rows are cut: which keys, and into which slices of time.

    Slices are ``width_us`` long. Each level of ``dense`` lists slices that are
    cut again into a number of equal pieces: ((slice, pieces), ...).
    """

    width_us: int = SLICE_US
    mode: str = "all"
    hot_share: float = HOT_SHARE
    hot_min_rows: int = HOT_MIN_ROWS
    origin_us: int = 0
    dense: tuple[tuple[tuple[int, int], ...], ...] = ()

    @classmethod
    def fit(cls, table: DataFrame, t_us: str, rows_per_slice: int = ROWS_PER_SLICE, **settings) -> Spread:
        """Slices of about ``rows_per_slice`` rows of a stored table, all keys together.

        However the rows are spread over keys, no key then has more than that in
        a slice. Time is first cut evenly; bursts, found by counting rows per
        slice, are cut again, and once more where the rows still crowd. Reads
        one column; what comes to the driver is bounded by ``MAX_SLICES``.
        """
        n, first, last = table.agg(F.count(t_us), F.min(t_us), F.max(t_us)).first()
        if not n:
            return cls(**settings)
        slices = min(max(1, -(-n // rows_per_slice)), MAX_SLICES)
        spread = cls(width_us=(last - first) // slices + 1, origin_us=first, **settings)
        while slices > 1 and len(spread.dense) < _LEVELS:
            counts = spread.add_slice(table.select(t_us), t_us).groupBy("_slice").agg(F.count(F.lit(1)).alias("n"))
            crowded = counts.where(F.col("n") > 2 * rows_per_slice).orderBy(F.desc("n")).limit(MAX_SLICES).collect()
            if not crowded:
                break
            pieces = sorted((r["_slice"], min(-(-r["n"] // rows_per_slice), _PIECES - 1)) for r in crowded)
            spread = replace(spread, dense=(*spread.dense, tuple(pieces)))
        return spread

    def add_slice(self, df: DataFrame, t_us: str) -> DataFrame:
        """Add ``_slice``, which never decreases with time."""
        width = F.lit(self.width_us).cast("bigint")
        out = df.withColumn("_slice", floor_div(F.col(t_us) - self.origin_us, self.width_us))
        if not self.dense:
            return out
        # _rest is the place inside the slice, scaled so that every slice is width_us long
        out = out.withColumn("_rest", F.col(t_us) - self.origin_us - F.col("_slice") * width)
        for level in self.dense:
            pieces = F.broadcast(df.sparkSession.createDataFrame(list(level), "_slice bigint, _pieces bigint"))
            out = (
                out.join(pieces, "_slice", "left")
                .withColumn("_rest", F.col("_rest") * F.coalesce("_pieces", F.lit(1)))
                .withColumn("_piece", floor_div(F.col("_rest"), self.width_us))
                .withColumn("_slice", F.col("_slice") * _PIECES + F.col("_piece"))
                .withColumn("_rest", F.col("_rest") - F.col("_piece") * width)
                .drop("_pieces", "_piece")
            )
        return out.select(*df.columns, "_slice")


ALL = Spread()
HOT = Spread(mode="hot")


@dataclass(frozen=True)
class Running:
    """Output name -> input column.

    sums  running total up to and including the row
    last  latest non-null value up to and including the row
    prev  latest non-null value strictly before the row
    next  earliest non-null value strictly after the row
    """

    sums: Mapping[str, str] = field(default_factory=dict)
    last: Mapping[str, str] = field(default_factory=dict)
    prev: Mapping[str, str] = field(default_factory=dict)
    next: Mapping[str, str] = field(default_factory=dict)


def hot_keys(df: DataFrame, keys: list[str], spread: Spread) -> DataFrame:
    """Keys with at least the share and number of rows; at most 1 / hot_share of them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.where(
        (F.col("_n") >= spread.hot_min_rows) & (F.col("_n") >= total * F.lit(spread.hot_share))
    ).select(*keys)


def cut(df: DataFrame, keys: list[str], t_us: str, spread: Spread) -> tuple[DataFrame, DataFrame | None]:
    """(all rows with ``_slice``, the rows of the keys that were cut or None if no key was).

    ``_slice`` is NULL for a key that is left in one piece. In mode "hot" the
    counting runs now, and only the found keys come to the driver: usually none,
    never more than ``1 / hot_share``.
    """
    if spread.mode == "all" or not keys:
        sliced = spread.add_slice(df, t_us)
        return sliced, sliced
    found = hot_keys(df, keys, spread)
    rows = found.collect()
    if not rows:
        return df.withColumn("_slice", F.lit(None).cast("bigint")), None
    hot = F.broadcast(df.sparkSession.createDataFrame(rows, found.schema).withColumn("_hot", F.lit(True)))
    everything = spread.add_slice(df, t_us).join(hot, keys, "left")
    sliced = everything.withColumn("_slice", F.when(F.col("_hot"), F.col("_slice"))).select(*df.columns, "_slice")
    return sliced, spread.add_slice(df.join(hot, keys).select(*df.columns), t_us)


def _over(keys: list[str], order: list[str], frame: str = "") -> str:
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return f"OVER ({by}ORDER BY {', '.join(order)}{' ' + frame if frame else ''})"


_TO_HERE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def running(df: DataFrame, keys: list[str], t_us: str, order: list[str], want: Running, spread: Spread = ALL) -> DataFrame:
    """Add the wanted running columns over ``keys`` in ``order`` (which starts with time).

    ``order`` must be total within a key, or equal rows may come out in any order.
    Rows with a NULL key belong to no key: nothing is carried to them.
    """
    sliced, cut_rows = cut(df, keys, t_us, spread)
    cell = [*keys, "_slice"]

    local = sliced.select(
        "*",
        *[F.expr(f"sum({c}) {_over(cell, order, _TO_HERE)}").alias(f"_l_{o}") for o, c in want.sums.items()],
        *[F.expr(f"last_value({c}) IGNORE NULLS {_over(cell, order, _TO_HERE)}").alias(f"_l_{o}") for o, c in want.last.items()],
        *[F.expr(f"lag({c}, 1) IGNORE NULLS {_over(cell, order)}").alias(f"_l_{o}") for o, c in want.prev.items()],
        *[F.expr(f"lead({c}, 1) IGNORE NULLS {_over(cell, order)}").alias(f"_l_{o}") for o, c in want.next.items()],
    )

    if cut_rows is None:
        totals = [F.coalesce(f"_l_{o}", F.lit(0)).alias(o) for o in want.sums]
        return local.select(*df.columns, *totals, *[F.col(f"_l_{o}").alias(o) for o in [*want.last, *want.prev, *want.next]])

    position = f"struct({', '.join(order)})"
    summary = cut_rows.groupBy(*cell).agg(
        *[F.sum(c).alias(f"_s_{o}") for o, c in want.sums.items()],
        *[
            F.expr(f"max_by({c}, CASE WHEN {c} IS NOT NULL THEN {position} END)").alias(f"_s_{o}")
            for o, c in {**want.last, **want.prev}.items()
        ],
        *[
            F.expr(f"min_by({c}, CASE WHEN {c} IS NOT NULL THEN {position} END)").alias(f"_s_{o}")
            for o, c in want.next.items()
        ],
    )
    backward = [*want.sums, *want.last, *want.prev]
    carry = summary.select(
        *cell,
        *[F.expr(f"coalesce(sum(_s_{o}) {_over(keys, ['_slice'], _BEFORE)}, 0)").alias(f"_c_{o}") for o in want.sums],
        *[F.expr(f"lag(_s_{o}, 1) IGNORE NULLS {_over(keys, ['_slice'])}").alias(f"_c_{o}") for o in backward if o not in want.sums],
        *[F.expr(f"lead(_s_{o}, 1) IGNORE NULLS {_over(keys, ['_slice'])}").alias(f"_c_{o}") for o in want.next],
    )

    # Plain equality keeps the partitioning of the windowed rows, so they are not shuffled again.
    joined = local.alias("r").join(carry.alias("c"), [F.col(f"r.{k}") == F.col(f"c.{k}") for k in cell], "left")

    def combined(name: str) -> Column:
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if name in want.sums:
            return (F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))).alias(name)
        return F.coalesce(here, before).alias(name)

    return joined.select(*[F.col(f"r.{c}") for c in df.columns], *[combined(o) for o in [*backward, *want.next]])


def as_of(
    probes: DataFrame,
    log: DataFrame,
    keys: list[str],
    t_us: str,
    values: list[str],
    *,
    log_first: bool = True,
    spread: Spread = ALL,
    log_order: str,
) -> DataFrame:
    """For every probe row the latest log row of the same keys at or before its time.

    The two sides are laid in one time line and the last log row is carried
    forward, so the work is linear and no range join is planned. ``log_first``
    decides whether a log row at the probe's very instant counts.
    """
    carried = "_log"
    rank = 0 if log_first else 2
    line = (
        probes.withColumn("_kind", F.lit(1)).withColumn("_pos", F.lit(0).cast("bigint"))
        .unionByName(
            log.select(
                *keys, t_us,
                F.lit(rank).alias("_kind"),
                F.col(log_order).cast("bigint").alias("_pos"),
                F.struct(*values).alias(carried),
            ),
            allowMissingColumns=True,
        )
    )
    found = running(line, keys, t_us, [t_us, "_kind", "_pos"], Running(last={"_found": carried}), spread)
    return found.where(F.col("_kind") == 1).select(*probes.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
