"""Named Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``root`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
