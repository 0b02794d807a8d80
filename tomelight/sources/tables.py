"""Readers of the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; columns and filters are pushed to the Parquet scan by what is asked of it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
