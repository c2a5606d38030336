"""File trees as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import paths

#: Bytes of files that one task reads.
TASK_BYTES = 64 << 20


def _system(root: str) -> tuple[pafs.FileSystem, str]:
    system, path = paths.system(root)
    return system, path.rstrip("/")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below root, path relative to it, hidden and empty files too. A root
    that isn't there gives no rows; one that is a file is an error. The driver lists names; tasks read."""
    root = paths.qualified(spark, str(root))
    system, base = _system(root)
    kind = system.get_file_info(base).type
    if kind == pafs.FileType.File:
        raise NotADirectoryError(root)
    found = [] if kind == pafs.FileType.NotFound else system.get_file_info(pafs.FileSelector(base, recursive=True))
    names = sorted((f.path[len(base) + 1 :], f.size or 0) for f in found if f.is_file)
    tasks = max(1, min(len(names), sum(size for _, size in names) // TASK_BYTES + 1))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, here = _system(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reach.open_input_file(f"{here}/{path}") as source:
                    text = source.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text], pa.string())], ["path", "content"])

    listed = spark.createDataFrame([(n,) for n, _ in names], "path string").repartition(tasks, "path")
    return listed.mapInArrow(contents, "path string, content string")


def write_tree(files: DataFrame, root: str) -> int:
    """Writes (path, content) below root, in the tasks; root must be a folder that they share. Files that
    are there are replaced, each as a whole. Returns the number written. Paths that lead out of root
    are an error; null contents aren't written."""
    root = paths.qualified(files.sparkSession, str(root))
    system, base = _system(root)
    system.create_dir(base, recursive=True)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, here = _system(root)
        for batch in batches:
            for path, content in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path} leads out of the tree")
                target = f"{here}/{path}"
                reach.create_dir(target.rpartition("/")[0], recursive=True)
                with reach.open_output_stream(f"{target}.part~", compression=None) as sink:
                    sink.write(content.encode())
                reach.move(f"{target}.part~", target)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    done = files.select("path", "content").dropna().mapInArrow(written, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return int(done.first().n)


def write_applied(applied: DataFrame, root: str) -> int:
    """Writes what an applied plan created or updated, nothing else."""
    changed = applied.filter(F.col("status").isin("created", "updated"))
    return write_tree(changed.select(F.col("destination_path").alias("path"), F.col("output").alias("content")), root)
