"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; the path goes to Spark's reader as it is, whatever store it names."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
