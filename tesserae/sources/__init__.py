"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(df: DataFrame, rows: int) -> int:
    """Partitions in which a table (its files say how many rows it has) has at most about so many rows each, a
    multiple of the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-df.count() // (rows * cores))) * cores


def spread(df: DataFrame, key: str | None = None, rows: int = 50_000) -> DataFrame:
    """df over at least as many partitions as there are cores. Only a table of fewer (a small one in a
    file or two) is repartitioned; use it before work in Python that takes long for each row. key: a column of
    distinct values, by which a table is divided if its partitions have more than about so many rows, so that a task's
    work doesn't grow with the table."""
    least = pieces(df, rows) if key else df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= least:
        return df
    return df.repartition(least, key) if key else df.repartition(least)
