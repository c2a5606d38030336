"""Queries over JSON, TOML, YAML, Markdown and source code. Only events.props is stored in such a form;
the other texts are put together from columns of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import structured
from tesserae.operators import match, nested, relational
from tesserae.sources import pieces, spread, table


def json_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = structured.analyze(F.col("props"), "json")
    rows = spread(table(spark, sf_dir, "events")).select("event_id", F.explode(a["owners"]).alias("o"))
    return rows.select("event_id", F.col("o.path").alias("path"), F.col("o.owner_kind").alias("owner_kind"), F.col("o.match_key").alias("match_key"))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template: props below a, and the user; destination: the event below a, and its type."""
    template = F.format_string('{"a":%s,"t":%d}', "props", "user_id")
    destination = F.format_string('{"u":"%s","a":{"z":%d}}', "event_type", "event_id")
    return spread(table(spark, sf_dir, "events"), "event_id").select(F.col("event_id").alias("pair_id"), template.alias("template"), destination.alias("destination"))


def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = structured.merge(F.col("template"), F.col("destination"), "json")
    return _pair(spark, sf_dir).select(F.col("pair_id").alias("event_id"), merged.alias("m")).select("event_id", "m.ok", "m.output")


def json_merge_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge over the nodes of both sides."""
    texts = _pair(spark, sf_dir).select("pair_id", F.posexplode(F.array("template", "destination")).alias("side", "source"))
    merged = relational.merge_tagged(relational.json_nodes(texts, "pair_id", "side"), pieces(table(spark, sf_dir, "events"), 50_000))
    return merged.filter("not is_object").select(F.col("pair_id").alias("event_id"), F.concat(F.lit("/"), F.array_join("path", "/")).alias("path"), "value")


def json_owner_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a pair are parsed in one batch of one reading."""
    texts = _pair(spark, sf_dir).select("pair_id", F.posexplode(F.array("template", "destination")).alias("side", "source"))
    owners = texts.select("pair_id", "side", F.explode(structured.analyze(F.col("source"), "json")["owners"]).alias("o")).select("pair_id", "side", "o.ord", "o.path")
    return match.match_tagged_owners(owners).select(F.col("pair_id").alias("event_id"), "status", "path")


def _merged(df: DataFrame, key: str, template: Column, destination: Column, family: str) -> DataFrame:
    rows = df.select(key, structured.merge(template, destination, family).alias("m"))
    return rows.select(key, "m.ok", F.element_at("m.policies", 1)["name"].alias("policy") if family != "markdown" else F.size("m.policies").cast("long").alias("policies"), "m.output")


def toml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    template = F.format_string('title = "order" # a comment\n[owner]\nkey = %d\nstatus = "%s"\n[owner.deep]\nx = [1, 2]\n', "o_custkey", "o_orderstatus")
    destination = F.format_string('[owner]\nkey = %d\n\n[zone]\npriority = "%s"\n', "o_orderkey", "o_orderpriority")
    return _merged(orders, "o_orderkey", template, destination, "toml")


def yaml_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part"))
    template = F.format_string("name: part\nsize:\n  key: %d\n  tags:\n    - a\n    - b c\n", "p_partkey")
    destination = F.format_string("size:\n  key: %d\nextra: [x, 'y z']\n", F.col("p_partkey") + 1)
    return _merged(parts, "p_partkey", template, destination, "yaml")


def markdown_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's page over a template with one more section."""
    customers = spread(table(spark, sf_dir, "customer"))
    template = F.format_string("# Template\n\nkey %d\n\n## More\n\n```json\n{}\n```\n", "c_custkey")
    destination = F.format_string("lost\n\n# Customer %d\n\nbody\n", "c_custkey")
    return _merged(customers, "c_custkey", template, destination, "markdown")


def ruby_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spread(table(spark, sf_dir, "customer"))
    template = F.format_string('require "set"\n\n# Keeps %d.\nclass Keeper\n  def key\n  end\nend\n\ndef other\n  %d\nend\n', "c_custkey", "c_custkey")
    destination = F.format_string("require 'json'\nclass Keeper\n  # mine %d\nend\n", "c_custkey")
    return _merged(customers, "c_custkey", template, destination, "ruby")


def go_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.format_string('package a\nimport "fmt"\nfunc A() int {\n\treturn %d\n}\nfunc B() {}\n', "s_suppkey")
    destination = F.format_string('package a\nimport (\n\t"os"\n)\nfunc B() { x := "%d}" }\n', "s_suppkey")
    return _merged(spread(table(spark, sf_dir, "supplier")), "s_suppkey", template, destination, "go")


def rust_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.format_string("use a::b;\npub fn one() -> u64 { %d }\nstruct Two;\n", "s_suppkey")
    destination = F.format_string("use c::{d, e};\nstruct Two { x: u64 } // %d\n", "s_suppkey")
    return _merged(spread(table(spark, sf_dir, "supplier")), "s_suppkey", template, destination, "rust")


def typescript_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.format_string('import {a} from "x";\nexport const k = {v: %d};\ninterface I { a: string }\n', "s_suppkey")
    destination = F.format_string('import z from "y";\nexport interface I {\n  b: "%d}";\n}\n', "s_suppkey")
    return _merged(spread(table(spark, sf_dir, "supplier")), "s_suppkey", template, destination, "typescript")


def markdown_nested_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged page whose code block is replaced by an output of its own."""
    parts = spread(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("pair_id"))
    pairs = parts.select("pair_id", F.lit("# T\n\n```json\n{}\n```\n").alias("template"), F.format_string("# D %d\n", "pair_id").alias("destination"))
    outputs = parts.select("pair_id", F.lit(0).alias("ord"), F.lit("document[0] > fenced_code_block[/code_fence/0]").alias("surface_address"), F.format_string('{"k":%d}\n', "pair_id").alias("output"))
    result = nested.merge_with_outputs(pairs, outputs, "markdown")
    return result.select(F.col("pair_id").alias("p_partkey"), "result.ok", "result.output")


QUERIES = {f.__name__: f for f in (json_owners, json_owner_match, json_merge, json_merge_relational, toml_merge, yaml_merge, markdown_merge, markdown_nested_merge, ruby_merge, go_merge, rust_merge, typescript_merge)}
_K = "json_extract_string(props, '$.k')"
ORACLES = {
    "json_owners": "SELECT event_id, '/' || k AS path, 'member' AS owner_kind, k AS match_key FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)",
    "json_owner_match": """SELECT event_id, unnest(['matched', 'unmatched_template', 'unmatched_template', 'unmatched_destination', 'unmatched_destination']) AS status,
  unnest(['/a', '/a/k', '/t', '/a/z', '/u']) AS path FROM events""",
    "json_merge": f"""SELECT event_id, true AS ok, '{{"a":{{"k":' || {_K} || ',"z":' || event_id || '}},"t":' || user_id || ',"u":"' || event_type || '"}}' AS output FROM events""",
    "json_merge_relational": f"""SELECT event_id, unnest(['/a/k', '/a/z', '/t', '/u']) AS path, unnest([{_K}, event_id::VARCHAR, user_id::VARCHAR, '"' || event_type || '"']) AS value FROM events""",
    "toml_merge": r"""SELECT o_orderkey, true AS ok, 'destination_wins_array' AS policy, 'title = "order"' || E'\n\n[owner]\nkey = ' || o_orderkey || E'\nstatus = "' || o_orderstatus
  || E'"\n\n[owner.deep]\nx = [1, 2]\n\n[zone]\npriority = "' || o_orderpriority || E'"\n' AS output FROM orders""",
    "yaml_merge": r"""SELECT p_partkey, true AS ok, 'destination_wins_array' AS policy, E'extra:\n  - x\n  - "y z"\nname: part\nsize:\n  key: ' || (p_partkey + 1) || E'\n  tags:\n    - a\n    - "b c"\n' AS output FROM part""",
    "markdown_merge": r"""SELECT c_custkey, true AS ok, 0::BIGINT AS policies, '# Customer ' || c_custkey || E'\n\nbody\n\n## More\n\n```json\n{}\n```\n' AS output FROM customer""",
    "markdown_nested_merge": r"""SELECT p_partkey, true AS ok, '# D ' || p_partkey || E'\n\n```json\n{"k":' || p_partkey || E'}\n```\n' AS output FROM part""",
    "ruby_merge": r"""SELECT c_custkey, true AS ok, 'destination_wins_array' AS policy, E'require ''json''\n\nclass Keeper\n  # mine ' || c_custkey || E'\nend\n\ndef other\n  ' || c_custkey || E'\nend\n' AS output FROM customer""",
    "go_merge": r"""SELECT s_suppkey, true AS ok, 'destination_wins_array' AS policy, E'"os"\n\nfunc B() { x := "' || s_suppkey || E'}" }\n\nfunc A() int {\n\treturn ' || s_suppkey || E'\n}\n' AS output FROM supplier""",
    "rust_merge": r"""SELECT s_suppkey, true AS ok, 'destination_wins_array' AS policy, E'use c::{d, e};\n\nstruct Two { x: u64 }\n\npub fn one() -> u64 { ' || s_suppkey || E' }\n' AS output FROM supplier""",
    "typescript_merge": r"""SELECT s_suppkey, true AS ok, 'destination_wins_array' AS policy, E'import z from "y";\n\nexport interface I {\n  b: "' || s_suppkey || E'}";\n}\n\nexport const k = {v: ' || s_suppkey || E'};\n' AS output FROM supplier""",
}
