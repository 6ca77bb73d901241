"""Shards of nearly equal bytes by histogram sort (DataFrame functions only).

Rows have an order of several 64-bit keys, the last of which no two rows share. A border between two shards should stand
where a given number of bytes lies below it. Each round puts evenly spaced probes into the ranges in which borders are
still sought, and counts, over all partitions at once, the exact bytes between them; the range that holds the border is
probed again, until its border is known. Then rows change places once.

Where equal texts allow it they stay in one shard: the first key is a digest of the text, and a border that can stand
between two texts within the tolerance does so. Otherwise a border stands between two rows, at the one nearest to the
wanted byte. So the result depends on the rows alone, not on partitions or on the spacing of the probes.

Null texts count as empty, with the checksum of nothing. Rows without an id, repeated rows and ids that several rows
share are dealt like others. No rows give no rows; columns of other names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import stored, text_or_empty
from chatstream.llm.ranking import ranked

#: Bytes that each row takes besides its text.
OVERHEAD = 8
#: A border may stand this share of a shard's bytes away from its place to keep equal texts together.
TOLERANCE = 0.01
#: Probes in a range: two to this power, in the first round and later.
FIRST_BITS, BITS = 12, 8
_NO_ID = -(2**63)


@dataclass(frozen=True)
class Border:
    """Rows whose first keys are less than ``at`` (or equal to it, if ``inclusive``) lie below."""

    at: tuple[int, ...]
    inclusive: bool

    def above(self, keys: list[str]) -> Column:
        row = F.struct(*(F.col(k) for k in keys[: len(self.at)]))
        at = F.struct(*(F.lit(v).cast("bigint") for v in self.at))
        return row > at if self.inclusive else row >= at


@dataclass(frozen=True)
class Range:
    """Rows with these first keys and the next one from ``low`` to ``high``; ``below`` bytes come before."""

    first: tuple[int, ...]
    low: int
    high: int
    below: int
    bits: int

    @property
    def shift(self) -> int:
        return max(0, (self.high - self.low).bit_length() - self.bits)

    def holds(self, keys: list[str]) -> Column:
        found = F.col(keys[len(self.first)]).between(F.lit(self.low), F.lit(self.high))
        for key, value in zip(keys, self.first):
            found = found & (F.col(key) == F.lit(value))
        return found

    def probe(self, keys: list[str]) -> Column:
        return F.shiftright(keys[len(self.first)], self.shift) - F.lit(self.low >> self.shift)


def _counted(rows: DataFrame, keys: list[str], size: str, ranges: list[Range]) -> list[list]:
    """For each range its probes in order: (bytes, rows, least and greatest key)."""
    index = probe = value = F.lit(None).cast("bigint")
    for j, r in reversed(list(enumerate(ranges))):
        holds = r.holds(keys)
        index = F.when(holds, F.lit(j).cast("bigint")).otherwise(index)
        probe = F.when(holds, r.probe(keys)).otherwise(probe)
        value = F.when(holds, F.col(keys[len(r.first)])).otherwise(value)
    inside = rows.select(index.alias("range"), probe.alias("probe"), value.alias("value"), F.col(size).alias("size")).where("range is not null")
    counts = inside.groupBy("range", "probe").agg(F.sum("size"), F.count("*"), F.min("value"), F.max("value")).collect()
    found: list[list] = [[] for _ in ranges]
    for range_no, _, *what in sorted(map(tuple, counts)):
        found[range_no].append(what)
    return found


def borders(rows: DataFrame, keys: list[str], size: str, targets: list[int], tolerance: int) -> list[Border]:
    """The border for each of these numbers of bytes below it. No two rows may agree in all keys; sizes are positive.

    The driver gets at most two to the power of ``BITS`` counts for each border and round. A round leaves a range that
    is 256 times narrower, so a few rounds find the border, also within one text that fills several shards.
    """
    ends = rows.agg(*(f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("low", F.min), ("high", F.max)))).first()
    spans = [(ends[f"low{i}"], ends[f"high{i}"]) for i in range(len(keys))]
    found: dict[int, Border] = {}
    if spans[0][0] is None:
        return []
    sought = {t: Range((), *spans[0], 0, FIRST_BITS) for t in set(targets)}
    while sought:
        ranges = list(dict.fromkeys(sought.values()))
        counts = dict(zip(ranges, _counted(rows, keys, size, ranges)))
        following: dict[int, Range] = {}
        for target, r in sought.items():
            below = r.below
            for held, n, low, high in counts[r]:  # noqa: B007
                if below + held > target:
                    break
                below += held
            # the border is at the start of this probe, inside it or, for the last one, at its end
            level, at = len(r.first), (*r.first, low)
            if low < high:
                following[target] = Range(r.first, low, high, below, BITS)
                continue
            left, right = target - below, below + held - target
            near = left == 0 or n == 1 or level == len(keys) - 1 or (level == 0 and min(left, right) <= tolerance)
            if near:
                found[target] = Border(at, inclusive=right < left)
            else:
                following[target] = Range(at, *spans[level + 1], below, BITS)
        sought = following
    return [found[t] for t in targets]


def _position(borders_: list[Border], keys: list[str], low: int, high: int) -> Column:
    """The number of borders at or below a row, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(borders_[middle].above(keys), _position(borders_, keys, middle + 1, high)).otherwise(_position(borders_, keys, low, middle))


def sharded(rows: DataFrame, keys: list[str], size: str, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, 2 ... in key order within the shard).

    ``rows`` is read once a round: give a stored table of few columns. The rows themselves move once, by ranges of
    (shard, keys), so a shard of any size is spread over many tasks.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    targets = [k * total // shards for k in range(1, shards)]
    found = borders(rows, keys, size, targets, int(total * tolerance / shards))
    placed = rows.withColumn("shard", _position(found, keys, 0, len(found)).cast("int"))
    return ranked(placed, ["shard"], [F.col(k) for k in keys], "_rank").withColumn("slot", F.col("_rank") - 1).drop("_rank")


def shard_documents(docs: DataFrame, shards: int = 24, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: shards are not stable)."""
    text = text_or_empty("text")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("_group"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
    )
    placed = sharded(stored(rows, "sizes"), ["_group", "_id", "_row"], "size", shards, tolerance)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
