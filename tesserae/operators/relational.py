"""The keyed merge of nested documents over their nodes.

A node is (pair_id, path array<string>, is_object, value); objects have no value, arrays and scalars are leaves with
their JSON. Merged are the destination's nodes and those template nodes that are neither at a destination's path nor
below one of its leaves. A template node looks up its own path and its ancestors' paths, each an equality.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tesserae.formats import json_family, trees

_NODES = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("is_object", T.BooleanType()), T.StructField("value", T.StringType())]))


def _walk(value, path: list[str]) -> list[dict]:
    if not isinstance(value, dict):
        return [{"path": path, "is_object": False, "value": trees.dump(value)}]
    here = [{"path": path, "is_object": True, "value": None}]
    return here + [n for k, v in value.items() for n in _walk(v, [*path, k])]


def json_nodes(df: DataFrame, *keys: str) -> DataFrame:
    """The nodes of (pair_id, source), or of other keys; a source that can't be parsed has none."""

    @F.arrow_udf(_NODES)
    def nodes(sources: pa.Array) -> pa.Array:
        out = []
        for s in sources.to_pylist():
            try:
                out.append(None if s is None else _walk(json_family.load(s), []))
            except ValueError:
                out.append(None)
        return pa.array(out, to_arrow_type(_NODES))

    keys = keys or ("pair_id",)
    return df.select(*keys, F.explode(nodes("source")).alias("n")).select(*keys, "n.path", "n.is_object", "n.value")


def merge_nodes(template: DataFrame, destination: DataFrame) -> DataFrame:
    """The nodes of the merge. A tree whose root is no object is replaced whole."""
    return merge_tagged(template.withColumn("side", F.lit(0)).unionByName(destination.withColumn("side", F.lit(1)))).select(*destination.columns)


def merge_tagged(nodes: DataFrame, parts: int | None = None) -> DataFrame:
    """merge_nodes for both sides in one table with side 0 and 1; one shuffle, on the pair.

    Every node stands at its own path; a template node also looks at each path above. Over the rows of one
    path, the destination's are seen; a template node goes if one of its looks met a leaf, or its own a node.
    parts: the partitions of the shuffle, by the number of pairs. Without, the session's number holds however many
    there are, and AQE makes fewer of them, by bytes that are a small part of what they take when sorted.
    """
    own = F.size("path")
    looks = F.when(F.col("side") == 0, F.sequence(F.lit(0), own)).otherwise(F.array(own))
    divided = nodes.repartition(parts, "pair_id") if parts else nodes.repartition("pair_id")
    rows = divided.withColumn("depth", F.explode(looks)).withColumn("seen", F.slice("path", F.lit(1), F.col("depth")))
    there = Window.partitionBy("pair_id", "seen")
    at = lambda c: F.coalesce(F.bool_or((F.col("side") == 1) & c).over(there), F.lit(False))
    told = rows.withColumn("gone", (F.col("side") == 0) & (at(~F.col("is_object")) | (F.col("depth") == own) & at(F.lit(True))))
    one = told.groupBy("pair_id", "side", "path").agg(F.bool_or("gone").alias("gone"), F.first("is_object").alias("is_object"), F.first("value").alias("value"))
    return one.filter("not gone").select("pair_id", "path", "is_object", "value")


def render(nodes: DataFrame) -> DataFrame:
    """(pair_id, output): the nodes of each pair as compact JSON with keys in order."""

    def build(batch):
        root: dict = {}
        for path, value in zip(batch["path"], batch["value"], strict=True):
            here = root
            for k in ["", *path][:-1]:
                here = here.setdefault(k, {})
            key = ["", *path][-1]
            if value is None:
                here.setdefault(key, {})
            else:
                here[key] = json.loads(value)
        ordered = lambda v: {k: ordered(v[k]) for k in sorted(v)} if isinstance(v, dict) else v
        batch = batch.iloc[:1][["pair_id"]].copy()
        batch["output"] = trees.dump(ordered(root.get("", {})))
        return batch

    return nodes.groupBy("pair_id").applyInPandas(build, "pair_id long, output string")
