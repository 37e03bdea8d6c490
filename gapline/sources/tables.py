"""Readers of the study tables, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def each_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``df`` with repeated deliveries removed.

    A row delivered twice has the same content but for its delivery time, so
    the distinct rows without that time are the rows. Copies collapse before
    the shuffle, so many copies of one row don't meet in one task.
    """
    return df.select(*columns).distinct()
