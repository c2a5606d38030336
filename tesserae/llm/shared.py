"""The folder that all executors share, and cutting of lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.paths import qualified, system

__all__ = ["BROADCAST_ROWS", "cut", "fields", "folder", "named", "place", "qualified", "remove", "row", "small", "system"]
#: Up to so many rows of ids (8 bytes each) are broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session that has none gets a temporary
    folder; a cluster without one is an error, for its machines don't share a local folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tesserae-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that neither a lost executor nor a
    second use computes it again."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def place(spark: SparkSession, what: str) -> str:
    """A new qualified path in the shared folder."""
    return qualified(spark, f"{folder(spark)}/{what}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Removes what place() named, once nothing reads it any more."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def named(column: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def row(df: DataFrame) -> Column:
    """All of a row as one struct, so that no column's name can clash with an operator's own."""
    return F.struct(*(named(c) for c in df.columns))


def fields(df: DataFrame, **new: Column) -> list[Column]:
    """The columns of df out of the struct `row`, by name, or what new has for them."""
    return [new.get(c, F.col("row")[c]).alias(c) for c in df.columns]
