"""Writers for the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Plain parquet table."""
    df.write.mode("overwrite").parquet(path)


def write_panel(panel: DataFrame, path: str) -> None:
    """Panel partitioned by fiscal year; only the years present are replaced.

    The rebalance brings a year together, splits a year too large for one task
    and merges small ones, so files end up evenly sized.
    """
    (
        panel.hint("rebalance", "fiscal_year")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("fiscal_year")
        .parquet(path)
    )
