"""Loaders that map stored tables to the model: call log, prompts, budgets, catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_utc(c):
    """A zone-less time as a timestamp in the session's zone; watermarks accept no other kind."""
    return F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, tool, server, tokens, ts: one row per tool call."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("tool"),
        F.concat(F.lit("srv_"), (F.col("user_id") % 8).cast("string")).alias("server"),
        F.floor("value").cast("long").alias("tokens"),
        "ts",
    )


def since(df: DataFrame, start: datetime | None, column: str = "ts") -> DataFrame:
    """Rows at or after start; None keeps all."""
    return df if start is None else df.filter(F.col(column) >= F.lit(start))
