"""Access to the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark unchanged, so any store Spark reads works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``rows`` rows, else as it is for the planner to join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
