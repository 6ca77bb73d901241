"""Captured client frames, access logs and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatstream.schema import FRAME

ACCESS_ROW = "t_us bigint, method string, path string, status int, latency_ms double, client_ip string"


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(FRAME).json(path)


def read_access_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).schema(ACCESS_ROW).json(path)


def write_metrics(lines: DataFrame, path: str) -> None:
    """Exposition text, one sample per line. Samples are a bounded set, so one file holds them."""
    lines.select(F.col("line").alias("value")).coalesce(1).write.mode("overwrite").text(path)
