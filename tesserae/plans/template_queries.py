"""Template planning over pages: a page's URL path, with an ending by its number, is a template file; pages
with even numbers have a destination file too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import template as T
from tesserae.operators import requests, template
from tesserae.sources import spread, table

ENDINGS = (".md.example", ".rb", "/Gemfile", ".yml.no-osc.example", ".toml", ".jsonc", "/.env.local", ".TXT")
STRATEGIES = ("merge", "accept_template", "keep_destination", "raw_copy")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.element_at(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    path = F.concat(F.lit("p"), F.col("page_id").cast("string"), ending)
    content = F.concat(F.lit("at {APP|URL} and {X|Y:Z} "), F.col("url"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), path.alias("path"), F.when(F.col("page_id") % 3 == 0, content).otherwise(F.col("url")).alias("content"))


def _overrides(files: DataFrame) -> DataFrame:
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (F.col("ord") % 5 + 1).cast("int"))
    return files.filter(F.col("ord") % 5 < 4).select("ord", F.concat(F.lit("./"), T.logical_path(F.col("path"))).alias("path"), strategy.alias("strategy"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paths(spark, sf_dir)
    there = files.filter(F.col("ord") % 2 == 0).select(T.logical_path(F.col("path")).alias("path"), F.when(F.col("ord") % 4 == 0, F.col("content")).otherwise("old").alias("content"))
    return template.plan_execution(files, there, overrides=_overrides(files), replacements={"APP|URL": "here", "X|Y:Z": "{APP|URL}"} | {})


def template_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).select(F.col("ord").alias("page_id"), T.logical_path(F.col("path")).alias("path"))
    return rows.select("page_id", "path", T.classify(F.col("path")).alias("c")).select("page_id", "path", "c.file_type", "c.family", "c.dialect")


def template_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select(F.col("ord").alias("page_id"), "destination_path", "strategy", "destination_exists", "write_action", "execution_action", "ready", F.size("token_keys").cast("long").alias("n_tokens"), "prepared_template_content")


def template_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.preview(plan(spark, sf_dir)).select(F.col("ord").alias("page_id"), "status")


def template_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = template.apply(plan(spark, sf_dir))
    return applied.select(F.col("ord").alias("page_id"), "status", F.md5("output").alias("output_md5"), F.size("diagnostics").cast("long").alias("n_diagnostics"))


def template_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.summary(template.plan_report(plan(spark, sf_dir)), "create", "update", "keep", "blocked", "omitted")


def template_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.convergence(plan(spark, sf_dir))


#: Tokens as tags without attributes look, one segment or more.
TAGS = {"pre": "<", "post": ">", "separators": ["-"], "min_segments": 1}


def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of another look in whole pages: their keys, and the text with two of them replaced."""
    html = F.col("html")
    keys = F.array_join(F.array_sort(T.token_keys(html, TAGS)), " ")
    return spread(table(spark, sf_dir, "pages")).select("page_id", keys.alias("keys"), F.md5(T.resolve_tokens(html, {"p": "[par]", "b": "<p>"}, TAGS)).alias("resolved_md5"))


def _joined(entry: dict) -> dict:
    """A merger of one's own: both texts; TOML is refused."""
    if entry["family"] == "toml":
        return {"ok": False, "diagnostics": [{"severity": "error", "category": "parse_error", "message": f"no {entry['dialect']}"}]}
    return {"ok": True, "output": f"{entry['destination_content']}\n{entry['prepared_template_content']}"}


def template_apply_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = template.apply(plan(spark, sf_dir), _joined)
    return applied.select(F.col("ord").alias("page_id"), "status", F.md5("output").alias("output_md5"), F.array_join(F.transform("diagnostics", lambda d: d["message"]), " ").alias("messages"))


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mode = F.when(k % 4 == 0, "plan").when(k % 4 == 1, "apply").when(k % 4 == 2, "odd")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("profile_name"), mode.alias("mode"), F.when(k % 5 > 0, "t").alias("template_root"),
        F.when(k % 7 > 0, "d").otherwise("").alias("destination_root"), F.when(k % 3 == 0, "raw_copy").alias("default_strategy"),
    )


def session_option_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = requests.option_requests(_options(spark, sf_dir))
    return told.select("c_custkey", "resolved_mode", "ready", F.array_join("reasons", " ").alias("reasons"))


def session_profile_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with even keys have a profile."""
    name = F.concat(F.lit("p"), F.col("n_nationkey").cast("string"))
    profiles = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(name.alias("profile_name"), F.lit("reapply").alias("mode"), F.lit("keep_destination").alias("default_strategy"))
    told = requests.profile_requests(_options(spark, sf_dir), profiles)
    return told.select("c_custkey", "resolved_mode", "resolved_strategy", "ready", F.array_join("reasons", " ").alias("reasons"))


def session_payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    payloads = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, "options").when(k % 4 == 1, "").alias("request_kind"), F.when(k % 3 == 0, "x").alias("profile_name"), F.when(k % 2 == 0, "y").alias("default_profile_name"))
    return requests.payload_kinds(payloads).select("c_custkey", "kind", "name")


_LOGICAL = "'p' || page_id || ['.md', '.rb', '/Gemfile', '.yml', '.toml', '.jsonc', '/.env.local', '.TXT'][page_id % 8 + 1]"
_PLAN = f"""base AS (SELECT page_id, {_LOGICAL} AS path,
  CASE WHEN page_id % 5 < 4 THEN ['merge', 'accept_template', 'keep_destination', 'raw_copy'][page_id % 5 + 1] ELSE 'merge' END AS strategy,
  page_id % 2 = 0 AS found, CASE WHEN page_id % 3 = 0 THEN 'at {{APP|URL}} and {{X|Y:Z}} ' || url ELSE url END AS content FROM pages),
plan AS (SELECT *, CASE WHEN strategy = 'keep_destination' THEN 'keep' WHEN found THEN 'update' ELSE 'create' END AS write_action,
  CASE strategy WHEN 'keep_destination' THEN 'keep' WHEN 'raw_copy' THEN 'raw_copy' WHEN 'accept_template' THEN 'write_prepared_content' ELSE 'merge_prepared_content' END AS execution_action,
  CASE WHEN strategy IN ('keep_destination', 'raw_copy') THEN content ELSE regexp_replace(content, '^at [{{]APP[|]URL[}}] and [{{]X[|]Y:Z[}}] ', 'at here and {{APP|URL}} ') END AS prepared,
  CASE WHEN found THEN CASE WHEN page_id % 4 = 0 THEN content ELSE 'old' END END AS there FROM base)"""
QUERIES = {f.__name__: f for f in (template_classify, template_plan, template_preview, template_apply, template_summary, template_convergence, template_tokens, template_apply_own, session_option_requests, session_profile_requests, session_payload_kinds)}
_MODE = "CASE c_custkey % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'apply' WHEN 2 THEN 'odd' END"
_NO_ROOTS = "CASE WHEN c_custkey % 7 = 0 THEN 'missing_destination_root' END, {also}CASE WHEN c_custkey % 5 = 0 THEN 'missing_template_root' END"
ORACLES = {
    "template_tokens": """SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<([A-Za-z0-9_]+(?:-[A-Za-z0-9_]+)*)>', 1))), ' ') AS keys,
  md5(replace(replace(replace(html, '<p>', chr(1)), '<b>', '<p>'), chr(1), '[par]')) AS resolved_md5 FROM pages""",
    "template_apply_own": f"""WITH {_PLAN}, done AS (SELECT *, execution_action = 'merge_prepared_content' AND found AS merges, path LIKE '%.toml' AS refused FROM plan),
out AS (SELECT *, CASE WHEN merges AND refused THEN NULL WHEN merges THEN there || chr(10) || prepared WHEN execution_action = 'keep' THEN there ELSE prepared END AS output FROM done)
SELECT page_id, CASE WHEN merges AND refused THEN 'blocked' WHEN execution_action = 'keep' THEN CASE WHEN found THEN 'kept' ELSE 'created' END
  WHEN found AND there = output THEN 'kept' WHEN found THEN 'updated' ELSE 'created' END AS status, md5(output) AS output_md5, CASE WHEN merges AND refused THEN 'no toml' ELSE '' END AS messages FROM out""",
    "session_option_requests": f"""SELECT c_custkey, CASE WHEN {_MODE} IN ('plan', 'apply', 'reapply') THEN {_MODE} ELSE 'plan' END AS resolved_mode, c_custkey % 5 > 0 AND c_custkey % 7 > 0 AS ready,
  concat_ws(' ', {_NO_ROOTS.format(also='')}) AS reasons FROM customer""",
    "session_profile_requests": f"""WITH told AS (SELECT c_custkey, c_nationkey % 2 = 0 AS known, {_MODE} AS mode, CASE WHEN c_custkey % 3 = 0 THEN 'raw_copy' END AS strategy FROM customer),
asked AS (SELECT *, coalesce(mode, CASE WHEN known THEN 'reapply' END) AS m, concat_ws(' ', {_NO_ROOTS.format(also="CASE WHEN NOT known THEN 'missing_profile' END, ")}) AS reasons FROM told)
SELECT c_custkey, CASE WHEN m IN ('plan', 'apply', 'reapply') THEN m ELSE 'plan' END AS resolved_mode, CASE WHEN reasons = '' THEN coalesce(strategy, 'keep_destination') END AS resolved_strategy, reasons = '' AS ready, reasons FROM asked""",
    "session_payload_kinds": """WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'options' END AS said, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'x' END, CASE WHEN c_custkey % 2 = 0 THEN 'y' END) AS name FROM customer)
SELECT c_custkey, coalesce(said, CASE WHEN name IS NOT NULL THEN 'profile' ELSE 'options' END) AS kind, name FROM p""",
    "template_classify": f"""SELECT page_id, {_LOGICAL} AS path,
  ['markdown', 'ruby', 'gemfile', 'yaml', 'toml', 'json', 'dotenv', 'text'][page_id % 8 + 1] AS file_type,
  ['markdown', 'ruby', 'ruby', 'yaml', 'toml', 'json', 'dotenv', 'text'][page_id % 8 + 1] AS family,
  ['markdown', 'ruby', 'ruby', 'yaml', 'toml', 'jsonc', 'dotenv', 'text'][page_id % 8 + 1] AS dialect FROM pages""",
    "template_plan": f"""WITH {_PLAN} SELECT page_id, path AS destination_path, strategy, found AS destination_exists, write_action, execution_action,
  execution_action <> 'keep' AS ready, CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n_tokens, prepared AS prepared_template_content FROM plan""",
    "template_preview": f"""WITH {_PLAN} SELECT page_id, CASE execution_action WHEN 'keep' THEN CASE WHEN found THEN 'kept' END
  WHEN 'merge_prepared_content' THEN CASE WHEN NOT found THEN 'created' END
  ELSE CASE WHEN found AND there = prepared THEN 'kept' WHEN found THEN 'updated' ELSE 'created' END END AS status FROM plan""",
    "template_summary": f"""WITH {_PLAN} SELECT count(*) FILTER (write_action = 'create') AS "create", count(*) FILTER (write_action = 'update') AS "update",
  count(*) FILTER (write_action = 'keep') AS keep, 0::BIGINT AS blocked, 0::BIGINT AS omitted FROM plan""",
    "template_convergence": f"""WITH {_PLAN} SELECT path FROM plan WHERE execution_action <> 'keep' AND there IS DISTINCT FROM prepared""",
}
