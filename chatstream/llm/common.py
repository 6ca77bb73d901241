"""Reading the tables and the small helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstream.session import ship_package, stored

__all__ = ["once", "read", "stored", "text_or_empty"]


def once(key: str, make: Callable[[], Any]) -> Any:
    """A table or model that a worker process builds once, however many tasks it runs."""
    kept = sys.__dict__.setdefault("_chatstream_llm", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package()
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
