"""Sinks for audit tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header: in one file, as reports are a few rows."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def report_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON string with its keys sorted."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("report"))


def write_partition(df: DataFrame, path: str, by: str = "run_id") -> None:
    """Replace the partitions that ``df`` has and leave the others: an upsert of whole runs."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
