"""Readers of the store's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def records(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The wanted columns of a table with redelivered rows (equal ids) counted once."""
    df = table(spark, root, name)
    return (df.select(*columns) if columns else df).dropDuplicates(["id"])
