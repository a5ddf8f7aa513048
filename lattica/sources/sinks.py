"""Table sinks: Parquet partitioned by a key, and single-table outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A CSV with header, for small reports that people read."""
    df.write.mode("overwrite").csv(path, header=True)


def write_outputs(tables: dict[str, DataFrame], folder: str) -> None:
    """One Parquet table per name under ``folder``."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}")
