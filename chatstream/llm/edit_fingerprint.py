"""Document fingerprints by a randomised edit embedding.

A pointer walks over the characters of a text; at each step of an endless shared sequence of random functions it writes
the character it stands on and moves on or stays, as the step's function of that character says. Two texts that differ
by few edits fall back into step with each other after each, so their edit distance becomes a Hamming distance of what
was written. A fingerprint samples the written string at 256 places, four bits each. Place and bits depend on the
sample's number and the written length alone, and for similar lengths most places are the same (each is the last record
below the length of a fixed random sequence, so it is uniform over the whole length). Bands of samples find candidates,
the share of equal samples verifies them.

Texts are walked whole, one after the other; memory is bounded by an Arrow batch or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatstream.llm.common import once, stored, text_or_empty
from chatstream.llm.components import linked_components

SAMPLES, CLASSES, PERIOD = 256, 64, 4096
#: Characters read at each sampled place.
GRAM = 4
#: Bands of 6 samples: at a likeness of 0.8 a pair misses all of them with a probability of 1e-6.
BANDS, ROWS = 42, 6


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _walks() -> list[list[int]]:
    """By character class and step (modulo the period): the step at which the walk is on the next character."""
    moves = np.random.default_rng(21).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
    out = []
    for row in moves:
        at = np.flatnonzero(np.concatenate((row, row)))
        out.append(((at[np.searchsorted(at, np.arange(PERIOD))] + 1) % PERIOD).tolist())
    return out


def _records() -> np.ndarray:
    """By sample: the places at which its random sequence sets a new record, ascending."""
    chance = 1 - np.random.default_rng(22).random((SAMPLES, 96))
    out = np.zeros((SAMPLES, 97))
    for k in range(96):
        out[:, k + 1] = np.minimum(np.floor((out[:, k] + 1) / chance[:, k]), 2.0**52)
    return out.astype(np.int64)


class Walk:
    """The embedding of one text: code points and the written length after each."""

    def __init__(self, text: str, start: Walk | None = None, keep: int = 0):
        """With ``start``, the first ``keep`` code points are those of another walk, which is carried on."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.classes: list[int] = (_mixed(points.astype(np.uint64) + np.uint64(99)) % np.uint64(CLASSES)).tolist()
        self.places: list[int] = []
        j = 0
        if start is not None and keep:
            points = np.concatenate((start.points[:keep], points))
            self.places = start.places[:keep]
            j = self.places[-1]
        self.points, add = points, self.places.append
        for row in map(once("walks", _walks).__getitem__, self.classes):
            j = row[j]
            add(j)

    def fingerprint(self) -> str:
        """SAMPLES hexadecimal digits."""
        number = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(40)
        if not self.places:
            return _hex(_mixed(number))
        steps = np.diff(np.array(self.places, np.int64), prepend=0) % PERIOD
        steps[steps == 0] = PERIOD
        written = np.cumsum(steps)
        known = once("records", _records)
        place = known[np.arange(SAMPLES), (known < written[-1]).sum(1) - 1]
        at = np.searchsorted(written, place, "right")
        value = number
        padded = np.concatenate((self.points, np.zeros(GRAM, np.uint32))).astype(np.uint64)
        for k in range(GRAM):
            with np.errstate(over="ignore"):
                value = _mixed(value * np.uint64(0x9E3779B97F4A7C15) + padded[at + k] + np.uint64(1))
        return _hex(value)


def _hex(values: np.ndarray) -> str:
    return "".join("0123456789abcdef"[v] for v in (values >> np.uint64(60)).tolist())


def likeness(a: str, b: str) -> float:
    """Share of equal samples, less what chance gives, 0 to 1."""
    equal = int(np.count_nonzero(np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)))
    return max(0.0, (equal / SAMPLES - 1 / 16) / (15 / 16))


def range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below the value, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    block = max(1, int(len(bounds) ** 0.5))
    fine, coarse = F.array(*map(F.lit, bounds)), F.array(*map(F.lit, bounds[block - 1::block]))
    full = F.size(F.filter(coarse, lambda b: b <= value)) * block
    return full + F.size(F.filter(F.slice(fine, full + 1, F.lit(block)), lambda b: b <= value))


def in_order(documents: DataFrame) -> DataFrame:
    """part, extra, doc_id, text: documents dealt into ranges of doc_id.

    A range holds the first row of the range below it as an extra row (the lowest holds the first of all), so that each
    row's successor in descending order is in the same range. Texts are shuffled once; only the bounds of the ranges
    and the largest doc_id of each come to the driver.
    """
    spark = documents.sparkSession
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("place"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / n for k in range(1, n)]
    found = rows.agg(F.percentile_approx("place", shares, 100 * n)).first()[0] if shares else []
    part = range_number(F.col("place"), sorted(set(found or [])))
    rows = rows.withColumn("part", part)
    heads = sorted((tuple(r) for r in rows.groupBy("part").agg(F.max("place")).collect()), reverse=True)
    if not heads:
        return rows.select("part", F.lit(0).alias("extra"), "doc_id", "text")
    above = {heads[(k + 1) % len(heads)][1]: p for k, (p, _) in enumerate(heads)}
    goes = F.create_map(*[F.lit(x) for pair in above.items() for x in pair])
    homes = F.array(F.struct(F.col("part"), F.lit(0).alias("extra")))
    also = goes[F.col("place")]
    homes = F.when(also.isNull(), homes).otherwise(F.concat(homes, F.array(F.struct(also.alias("part"), F.lit(1).alias("extra")))))
    dealt = rows.withColumn("home", F.explode(homes)).select("home.part", "home.extra", "place", "doc_id", "text")
    return dealt.repartition(n, "part").sortWithinPartitions("part", "extra", F.desc("place"), "text").drop("place")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with likenesses.

    The edited text has the last half (rounded down) replaced by as many first code points of the next document, which
    is the one with the next smaller doc_id (after the last: the first). Null texts are empty, a null doc_id is the
    smallest; rows with one doc_id follow each other by text. A single row is its own next. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for part, extra, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                walk = Walk(text)
                now = (part, extra, doc_id, text, walk, walk.fingerprint())
                if held is not None and not held[1] and held[0] == part:
                    out.append(_compared(held, now))
                held = now
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return in_order(documents).mapInArrow(run, SCHEMA)


def _compared(held: tuple, following: tuple) -> tuple:
    _, _, doc_id, text, walk, own = held
    n = len(text)
    tail = following[3][:n // 2]
    edited = text[:n - n // 2] + tail
    theirs = own if edited == text else Walk(tail, walk, n - n // 2).fingerprint()
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own, theirs, likeness(own, theirs), likeness(own, following[5])


def near_groups(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, group_id (smallest doc_id reached by links) and kept, for rows (doc_id, fingerprint).

    Two documents are linked when their likeness is at least ``least``. Rows with one fingerprint are one node. Rows
    without a doc_id or a fingerprint have no group.
    """
    known = prints.select("doc_id", "fingerprint")
    same = stored(known.filter("doc_id is not null and fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "prints")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("fingerprint", k * ROWS + 1, ROWS)) for k in range(BANDS)])
    enough = int(np.ceil((least * 15 / 16 + 1 / 16) * SAMPLES))
    found = linked_components(same.select(F.explode(bands).alias("bucket"), "node"), same.select("node", F.col("fingerprint").cast("binary").alias("signature")), np.uint8, enough)
    roots = stored(same.join(found, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("group_id")), "groups")
    return known.join(roots, "fingerprint", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("group_id")).alias("group_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("group_id"), F.lit(True)))
