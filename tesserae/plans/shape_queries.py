"""Merges of many shapes: nulls, arrays against objects, comments, errors on either side, several imports.

A row takes the shape that its key names; @ stands for the key. What is expected is written out, shape by
shape, from the rules of the merge, and the SQL looks it up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import structured
from tesserae.sources import spread, table

#: (template, destination, what is expected: the output, or the diagnostic's category behind an exclamation mark).
Shape = tuple[str, str, str]

JSON: list[Shape] = [
    ('{"a":@}', '{"b":1}', '{"a":@,"b":1}'),
    ('{"a":{"x":1,"y":@}}', '{"a":{"x":2}}', '{"a":{"x":2,"y":@}}'),
    ('{"a":[1,2]}', '{"a":[@]}', '{"a":[@]}'),
    ('{"a":{"x":1}}', '{"a":[@]}', '{"a":[@]}'),
    ('{"a":[1]}', '{"a":{"x":@}}', '{"a":{"x":@}}'),
    ('{"a":@}', '{"a":null}', '{"a":null}'),
    ('{"a":null}', '{"b":@}', '{"a":null,"b":@}'),
    ("{}", '{"k":@}', '{"k":@}'),
    ('{"k":@}', "{}", '{"k":@}'),
    ("[1]", '{"k":@}', '{"k":@}'),
    ('{"k":1}', "[@]", "[@]"),
    ('{"k":@', "{}", "!parse_error"),
    ('{"k":@}', '{"k":', "!destination_parse_error"),
    ('{"k":1,}', '{"k":@}', "!parse_error"),
    ('{"k":1,"z":0}', '{"k":@,}', '{"k":@,"z":0}'),
    ('{"k":1,"k":@}', '{"z":0}', '{"k":@,"z":0}'),
    ('{"a":{"b":{"c":1}}}', '{"a":{"b":{"d":@}}}', '{"a":{"b":{"c":1,"d":@}}}'),
    ('{"é":"ü@"}', '{"b":"\\u00fc"}', '{"b":"ü","é":"ü@"}'),
    (' { "b" : true , "a" : [ { } , [ ] , @ ] } ', "{}", '{"a":[{},[],@],"b":true}'),
    ('{"k":1} // c', '{"k":@}', "!parse_error"),
]
JSONC: list[Shape] = [
    ('{"k":1 /* @ */}', '{"z":@} // end', '{"k":1,"z":@}'),
    ('// @\n{"k":"/* no */","u":"//x"}', '{"z":@}', '{"k":"/* no */","u":"//x","z":@}'),
    ('{"k":1}', '{"z":[@, /* c */],}', "!destination_parse_error"),  # a comma before a comment isn't told as a trailing one
    ('{"k":1}', '{"z":[@,], // c\n}', "!destination_parse_error"),
    ('{"k":1}', '{"z":[@ // c\n,],\n}', '{"k":1,"z":[@]}'),
    ('{"k":/* open 1}', '{"z":@}', "!parse_error"),
]
TOML: list[Shape] = [
    ("a = @\n", "b = 1\n", "a = @\nb = 1\n"),
    ("[t]\nx = 1\ny = @\n", "[t]\nx = 2\n", "[t]\nx = 2\ny = @\n"),
    ("a = [1, 2]\n", "a = [@]\n", "a = [@]\n"),
    ("[a]\nx = 1\n", "a = @\n", "a = @\n"),
    ("a = 1\n", "[a]\nx = @\n", "[a]\nx = @\n"),
    ('a = "x # y" # c\n', "b = @\n", 'a = "x # y"\nb = @\n'),
    ("[a.b]\nx = @\n", "[a]\ny = 1\n", "[a]\ny = 1\n\n[a.b]\nx = @\n"),
    ("b = true\na = 1.5\n", "c = @\n", "a = 1.5\nb = true\nc = @\n"),
    ("a = \n", "b = @\n", "!parse_error"),
    ("b = @\n", "x\n", "!destination_parse_error"),
    ('a = "é"\r\n', "\n\nb = @\n", 'a = "é"\nb = @\n'),
    ("a = @\n", "", "a = @\n"),
    ("[z]\nk = 1\n", "top = @\n[a]\nk = 2\n", "top = @\n\n[a]\nk = 2\n\n[z]\nk = 1\n"),
]
YAML: list[Shape] = [
    ("a: @\n", "b: 1\n", "a: @\nb: 1\n"),
    ("a:\n  x: 1\n  y: @\n", "a:\n  x: 2\n", "a:\n  x: 2\n  y: @\n"),
    ("a: [1, 2]\n", "a:\n  - @\n", "a:\n  - @\n"),
    ("a:\n  x: 1\n", "a: @\n", "a: @\n"),
    ("a: 1\n", "a:\n  x: @\n", "a:\n  x: @\n"),
    ("a: '007'\nb: \"yes\"\n", "c: @\n", "a: 7\nb: true\nc: @\n"),
    ("a:\n", "b: @\n", "!unsupported_feature"),
    ("a: *x\n", "b: @\n", "!parse_error"),
    ("b: @\n", "- x\n", "!destination_parse_error"),
    ("a: |\n  x @\n  y\n", "b: 1\n", 'a: "x @\\ny\\n"\nb: 1\n'),
    ("# c\na: @ # d\n", "b: 'x # y'\n", 'a: @\nb: "x # y"\n'),
    ("a: 1.5\nb: true\n", "a: @\n", "a: @\nb: true\n"),
    ("a: one\n  two\nz: 1\n", "m: @\n", 'a: "one two"\nm: @\nz: 1\n'),
]
GO: list[Shape] = [
    ("package a\nfunc A() int {\n\treturn @\n}\n", 'package a\nimport (\n\t"os"\n\tx "os"\n\t"fmt"\n)\nfunc B() {}\n', 'x "os"\n"fmt"\n\nfunc B() {}\n\nfunc A() int {\n\treturn @\n}\n'),
    ('package a\nimport "fmt"\nfunc A() {}\n', "package a\nfunc A() { _ = @ }\n", "func A() { _ = @ }\n"),
    ("package a\nfunc A( {\n", "package a\nfunc B() {}\n", "!parse_error"),
    ("package a\ntype T struct{ k int }\n", "package a\n// @ }\nfunc B() {\n", "!destination_parse_error"),
]


def _query(name: str, source: str, key: str, family: str, dialect: str, shapes: list[Shape]) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    def shape(k: int) -> Column:
        each = F.array(*[F.lit(s[k]) for s in shapes])
        return F.replace(F.element_at(each, (F.col(key) % len(shapes) + 1).cast("int")), F.lit("@"), F.col(key).cast("string"))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        merged = structured.merge(shape(0), shape(1), family, dialect)
        rows = spread(table(spark, sf_dir, source)).select(key, merged.alias("m"))
        return rows.select(key, "m.ok", "m.output", F.try_element_at(F.col("m.diagnostics.category"), F.when(~F.col("m.ok"), 1).otherwise(99)).alias("category"))

    query.__name__, query.__doc__ = name, f"{family} of {len(shapes)} shapes."
    quoted = ", ".join("'" + s[2].replace("'", "''") + "'" for s in shapes)
    sql = f"""WITH told AS (SELECT {key}, replace([{quoted}][{key} % {len(shapes)} + 1], '@', {key}::VARCHAR) AS t FROM {source})
SELECT {key}, NOT starts_with(t, '!') AS ok, CASE WHEN NOT starts_with(t, '!') THEN t END AS output, CASE WHEN starts_with(t, '!') THEN t[2:] END AS category FROM told"""
    return query, sql


_BUILT = {
    name: _query(name, *rest)
    for name, *rest in (
        ("json_merge_shapes", "part", "p_partkey", "json", "json", JSON), ("jsonc_merge_shapes", "part", "p_partkey", "json", "jsonc", JSONC), ("toml_merge_shapes", "part", "p_partkey", "toml", "toml", TOML),
        ("yaml_merge_shapes", "part", "p_partkey", "yaml", "yaml", YAML), ("go_merge_shapes", "supplier", "s_suppkey", "go", "go", GO),
    )
}
QUERIES = {name: q for name, (q, _) in _BUILT.items()}
ORACLES = {name: sql for name, (_, sql) in _BUILT.items()}
