"""Analysis and merge of text columns, family by family, in Arrow batches.

Recursive documents have no fixed schema, so parsing and merging are Python's; a row's whole work is one
call and nothing is shuffled. Null sources give null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tesserae import formats
from tesserae.contracts import ANALYSIS, MERGE_RESULT


def result_type(ddl: str) -> tuple[T.DataType, pa.DataType]:
    """A struct's type for Spark and for Arrow."""
    kind = T.StructType.fromDDL(f"x {ddl}")[0].dataType
    return kind, to_arrow_type(kind)


def analyze(source: Column, family: str, dialect: str | None = None, backend: str | None = None) -> Column:
    """The ANALYSIS of each source: ok and diagnostics, or owners in order and the normalised text."""
    spark_type, arrow_type = result_type(ANALYSIS)

    @F.arrow_udf(spark_type)
    def analysed(sources: pa.Array) -> pa.Array:
        out = [formats.parse(s, family, dialect or family, backend) for s in sources.to_pylist()]
        for a in out:
            for k, o in enumerate((a or {}).get("owners") or ()):
                o["ord"] = k
        return pa.array(out, arrow_type)

    return analysed(source)


def merge(template: Column, destination: Column, family: str, dialect: str | None = None, backend: str | None = None) -> Column:
    """The MERGE_RESULT of each pair: destination over template."""
    spark_type, arrow_type = result_type(MERGE_RESULT)

    @F.arrow_udf(spark_type)
    def merged(templates: pa.Array, destinations: pa.Array) -> pa.Array:
        both = zip(templates.to_pylist(), destinations.to_pylist(), strict=True)
        return pa.array([formats.merge(t, d, family, dialect or family, backend) for t, d in both], arrow_type)

    return merged(template, destination)


def splice(source: Column, outputs: Column, family: str) -> Column:
    """The MERGE_RESULT of putting outputs (a map from owner path or surface address to text) into a
    Markdown or Ruby source."""
    spark_type, arrow_type = result_type(MERGE_RESULT)
    put = {"markdown": formats.markdown.splice, "ruby": formats.ruby.splice}[family]

    @F.arrow_udf(spark_type)
    def spliced(sources: pa.Array, maps: pa.Array) -> pa.Array:
        both = zip(sources.to_pylist(), maps.to_pylist(), strict=True)
        return pa.array([None if s is None else put(s, dict(m or {})) for s, m in both], arrow_type)

    return spliced(source, outputs)
