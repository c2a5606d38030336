"""Conformance and review over labels and events: a labelled document or an event is a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import conformance, envelopes, review
from tesserae.sources import table

POLICIES = "array<struct<surface:string,name:string>>"


def conformance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By customer segment of the event's type: passed, failed, skipped, and another outcome."""
    outcome = F.element_at(F.array(*[F.lit(o) for o in ("passed", "failed", "skipped", "unknown")]), (F.col("user_id") % 4 + 1).cast("int"))
    return conformance.summarize(table(spark, sf_dir, "events").select("event_type", outcome.alias("outcome")), "event_type")


def conformance_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.sum_summaries(conformance_summary(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    policy = lambda name: F.struct(F.lit("array").alias("surface"), F.lit(name).alias("name"))
    backend = F.when(k % 3 == 0, "fast").when(k % 3 == 1, "slow")
    dialect = F.when(k % 4 == 0, "json").when(k % 4 == 1, "jsonc").when(k % 4 == 2, "yaml")
    requirements = F.struct(backend.alias("backend"), dialect.alias("dialect"), F.when(k % 5 == 0, F.array(policy("known"), policy("strange"), policy("quiet"))).alias("policies"))
    family = F.struct(F.lit("json").alias("family"), F.array(F.lit("json"), F.lit("jsonc")).alias("supported_dialects"), F.array(policy("known"), policy("quiet")).alias("supported_policies"))
    feature = F.when(k % 2 == 0, F.struct(F.lit("fast").alias("backend"), F.lit(False).alias("supports_dialects"), F.array(policy("known")).alias("supported_policies")))
    ref = F.struct(F.lit("json").alias("family"), F.lit("merge").alias("role"), F.concat(F.lit("case "), k.cast("string")).alias("case"))
    return suppliers.select("s_suppkey", ref.alias("ref"), requirements.alias("requirements"), family.alias("family_profile"), feature.alias("feature_profile"))


def conformance_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.select_cases(_runs(spark, sf_dir)).select("s_suppkey", "status", F.array_join("messages", " ").alias("messages"))


def conformance_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected cases are run by a function that fails one in seven."""
    ran = conformance.run_suite(_runs(spark, sf_dir), lambda row: ("failed", ["odd"]) if int(row["ref"]["case"][5:]) % 7 == 0 else ("passed", []))
    return ran.select(F.substring("ref.case", 6, 20).cast("long").alias("s_suppkey"), "outcome", F.size("messages").cast("long").alias("n_messages"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("group "), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("case_id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("delegated_case_id"), group.alias("delegated_apply_group"),
        F.col("o_orderstatus").alias("parent_operation_id"), F.col("o_orderpriority").alias("child_operation_id"), F.lit("/x").alias("delegated_runtime_surface_path"),
    )


def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = review.group_cases(_cases(spark, sf_dir))
    return grouped.select("delegated_apply_group", F.col("ord").alias("first"), "parent_operation_id", "child_operation_id", F.array_join("case_ids", ",").alias("case_ids"), F.array_join("delegated_case_ids", ",").alias("delegated_case_ids"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("case_id"))


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = review.progress(review.group_cases(_cases(spark, sf_dir)), _resolved(spark, sf_dir))
    return told.select("delegated_apply_group", F.array_join("resolved_case_ids", ",").alias("resolved"), F.array_join("pending_case_ids", ",").alias("pending"), "complete")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every other customer, some on groups that there never were."""
    action = F.when(F.col("c_custkey") % 6 == 0, "wait").otherwise(review.APPLY)
    request = F.concat(F.when(F.col("c_custkey") % 10 == 4, "projected_child_group:nobody ").otherwise("projected_child_group:group "), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("ord"), request.alias("request_id"), action.alias("action"))


def review_apply_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = review.apply_plan(review.group_cases(_cases(spark, sf_dir)), _decisions(spark, sf_dir), "ruby")
    return planned.select("request_id", "family", F.col("decision.ord").alias("decision"), F.size("delegated_group.case_ids").cast("long").alias("n_cases"))


def review_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = review.rejected_decisions(review.group_cases(_cases(spark, sf_dir)), _decisions(spark, sf_dir))
    return lost.select("request_id", "reason", F.col("diagnostic.category").alias("category"))


def review_open_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_requests(review.group_cases(_cases(spark, sf_dir)), _decisions(spark, sf_dir), "ruby").select("id", "message")


def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as payloads, exported and read back; one in five as another kind, one in seven as another version."""
    kind = "structured_edit_application"
    sent = envelopes.export(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), kind)
    sent = F.when(F.col("n_nationkey") % 5 == 0, F.replace(sent, F.lit(kind), F.lit("other"))).when(F.col("n_nationkey") % 7 == 0, F.replace(sent, F.lit('"version":1'), F.lit('"version":2'))).otherwise(sent)
    got = table(spark, sf_dir, "nation").select("n_nationkey", envelopes.read(sent, kind, "struct<key:bigint,name:string>").alias("r"))
    return got.select("n_nationkey", "r.payload.name", "r.error.category", "r.error.message")


_GROUPS = """cases AS (SELECT o_orderkey AS ord, 'group ' || o_custkey AS g, o_orderstatus AS p, o_orderpriority AS c FROM orders),
groups AS (SELECT g, min(ord) AS first, arg_min(p, ord) AS p, arg_min(c, ord) AS c, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS ids, string_agg('d' || ord, ',' ORDER BY ord) AS dids,
  coalesce(string_agg(CASE WHEN p = 'F' THEN ord::VARCHAR END, ',' ORDER BY ord), '') AS done, coalesce(string_agg(CASE WHEN p <> 'F' THEN ord::VARCHAR END, ',' ORDER BY ord), '') AS open, count(*) AS n FROM cases GROUP BY g),
decisions AS (SELECT c_custkey AS ord, 'projected_child_group:' || g AS request_id, g FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 4 THEN 'nobody ' ELSE 'group ' END || c_custkey AS g FROM customer) WHERE c_custkey % 2 = 0 AND c_custkey % 6 <> 0)"""
_OUTCOME = "['passed', 'failed', 'skipped', 'unknown'][user_id % 4 + 1]"
_COUNTS = f"count(*) AS total, count(*) FILTER ({_OUTCOME} = 'passed') AS passed, count(*) FILTER ({_OUTCOME} = 'failed') AS failed, count(*) FILTER ({_OUTCOME} = 'skipped') AS skipped"
_SELECT = """told AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 2 THEN NULL
  WHEN s_suppkey % 2 = 1 THEN 'case requires backend ' || ['fast', 'slow'][s_suppkey % 3 + 1] || ' but no backend feature profile is available for family json.'
  WHEN s_suppkey % 3 = 1 THEN 'case requires backend slow but backend fast is active for family json.' END AS b,
  CASE WHEN s_suppkey % 4 = 2 THEN 'family json does not support dialect yaml.' END AS d,
  CASE WHEN s_suppkey % 5 = 0 THEN 'family json does not support policy strange.' END AS p,
  CASE WHEN s_suppkey % 10 = 0 THEN 'backend fast does not support policy quiet.' END AS q FROM supplier)"""
QUERIES = {f.__name__: f for f in (conformance_summary, conformance_total, conformance_select, conformance_run, review_groups, review_progress, review_apply_plan, review_rejected, review_open_requests, envelope_round_trip)}
ORACLES = {
    "conformance_summary": f"SELECT event_type, {_COUNTS} FROM events GROUP BY event_type",
    "conformance_total": f"SELECT {_COUNTS} FROM events",
    "conformance_select": f"WITH {_SELECT} SELECT k AS s_suppkey, CASE WHEN coalesce(b, d, p, q) IS NULL THEN 'selected' ELSE 'skipped' END AS status, concat_ws(' ', b, d, p, q) AS messages FROM told",
    "conformance_run": f"""WITH {_SELECT} SELECT k AS s_suppkey, CASE WHEN coalesce(b, d, p, q) IS NOT NULL THEN 'skipped' WHEN k % 7 = 0 THEN 'failed' ELSE 'passed' END AS outcome,
  CASE WHEN coalesce(b, d, p, q) IS NULL THEN (k % 7 = 0)::INT ELSE (b IS NOT NULL)::INT + (d IS NOT NULL)::INT + (p IS NOT NULL)::INT + (q IS NOT NULL)::INT END::BIGINT AS n_messages FROM told""",
    "review_groups": f"WITH {_GROUPS} SELECT g AS delegated_apply_group, first, p AS parent_operation_id, c AS child_operation_id, ids AS case_ids, dids AS delegated_case_ids FROM groups",
    "review_progress": f"WITH {_GROUPS} SELECT g AS delegated_apply_group, done AS resolved, open AS pending, open = '' AS complete FROM groups",
    "review_apply_plan": f"WITH {_GROUPS} SELECT request_id, 'ruby' AS family, ord AS decision, n AS n_cases FROM groups JOIN decisions USING (g)",
    "review_rejected": f"WITH {_GROUPS} SELECT request_id, 'request_not_found' AS reason, 'replay_rejected' AS category FROM decisions WHERE g NOT IN (SELECT g FROM groups)",
    "review_open_requests": f"WITH {_GROUPS} SELECT 'projected_child_group:' || g AS id, 'delegated child group ' || g || ' is ready to apply for ruby.' AS message FROM groups WHERE g NOT IN (SELECT g FROM decisions)",
    "envelope_round_trip": """SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0 THEN n_name END AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN 'kind_mismatch' WHEN n_nationkey % 7 = 0 THEN 'unsupported_version' END AS category,
  CASE WHEN n_nationkey % 5 = 0 THEN 'expected structured_edit_application envelope kind.' WHEN n_nationkey % 7 = 0 THEN 'unsupported structured_edit_application envelope version 2.' END AS message FROM nation""",
}
