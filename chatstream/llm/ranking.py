"""Exact row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatstream.llm.common import stored


def ranked(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... within each group in this order.

    Rows are dealt once, by ranges of (group, order), so a group that holds most rows is spread over many tasks; they
    are counted off inside each range, and the ranges before it (one number for each range and group) say where to
    start. Rows that tie in everything are told apart by a running number, which spreads those too; which of them
    comes first is open. The written table fixes the ranges, so a lost executor cannot change them.
    """
    keys = [F.col(c) for c in group]
    apart = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = apart.repartitionByRange(*keys, *order, "_tie").sortWithinPartitions(*keys, *order, "_tie").drop("_tie")
    kept = stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "ranges")
    counts = kept.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_range").alias("_r"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_from"))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return kept.join(starts, same).withColumn(name, F.col("_at") + F.col("_from") + 1).select(*rows.columns, name)
