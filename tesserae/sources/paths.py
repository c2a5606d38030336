"""Paths that mean the same on the driver and on every executor."""

from __future__ import annotations

import re

import pyarrow.fs as pafs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and authority that Spark gives it: a bare one is of fs.defaultFS, not of
    the machine that happens to open it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(conf).makeQualified(there).toString()


def system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path and the path in it, for use on any machine. s3a is s3 there."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        raise ValueError(f"{path} has no scheme; see qualified()")
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"\Afile:/*", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"\As3[an]://", "s3://", path))
