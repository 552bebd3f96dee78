"""The events table as telemetry of several assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSETS = 4
FLAGS = ("click", "error", "view")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, ts, us, value, is_click, is_error, is_view): one analog channel and three flags."""
    e = events(spark, sf_dir)
    ts = F.col("ts").cast("timestamp")
    flags = [(F.col("event_type") == f).cast("double").alias(f"is_{f}") for f in FLAGS]
    return e.select((F.col("user_id") % ASSETS).cast("string").alias("asset_id"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("value"), *flags)
