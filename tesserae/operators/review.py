"""Review of delegated child groups and family contexts, and the replay of decisions.

Order is part of the data: cases and decisions carry ord.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.contracts import DIAGNOSTIC

APPLY = "apply_delegated_child_group"


def group_cases(cases: DataFrame) -> DataFrame:
    """Cases (ord, case_id, delegated_case_id, delegated_apply_group, parent_operation_id,
    child_operation_id, delegated_runtime_surface_path) by apply group: the first one's attributes and
    the ids in order. ord is the first case's."""
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("x")))), lambda s: s["x"]).alias(f"{c}s")
    first = [F.min_by(c, "ord").alias(c) for c in ("parent_operation_id", "child_operation_id", "delegated_runtime_surface_path")]
    return cases.groupBy("delegated_apply_group").agg(F.min("ord").alias("ord"), *first, ids("case_id"), ids("delegated_case_id"))


def progress(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """groups with resolved_case_ids, pending_case_ids and complete, by the case ids in resolved (case_id).

    The ids are joined, not collected: groups are exploded by case and put together again."""
    done = resolved.select("case_id").distinct().withColumn("done", F.lit(True))
    rows = groups.select("*", F.posexplode_outer("case_ids").alias("at", "case_id")).join(done, "case_id", "left")
    pick = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("at", "case_id")))), lambda s: s["case_id"])
    is_done = F.coalesce("done", F.lit(False))
    told = rows.groupBy("delegated_apply_group").agg(pick(is_done).alias("resolved_case_ids"), pick(~is_done & F.col("case_id").isNotNull()).alias("pending_case_ids"))
    return groups.join(told, "delegated_apply_group").withColumn("complete", F.size("pending_case_ids") == 0)


def ready_for_apply(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """The groups of which every case is resolved."""
    return progress(groups, resolved).filter("complete").select(*groups.columns)


def request_id(group: str = "delegated_apply_group") -> Column:
    return F.concat(F.lit("projected_child_group:"), F.col(group))


def applied_decisions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """The apply decisions (ord, request_id, action) that name a group's request."""
    return decisions.filter(F.col("action") == APPLY).join(groups.select(request_id().alias("request_id")), "request_id", "left_semi")


def accepted_groups(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """The groups that an apply decision names."""
    named = applied_decisions(groups, decisions).select("request_id")
    return groups.withColumn("request_id", request_id()).join(named, "request_id", "left_semi").select(*groups.columns)


def review_requests(groups: DataFrame, decisions: DataFrame, family: str) -> DataFrame:
    """A request for each group that isn't accepted."""
    named = applied_decisions(groups, decisions).select("request_id")
    rest = groups.withColumn("request_id", request_id()).join(named, "request_id", "left_anti")
    message = F.concat(F.lit("delegated child group "), F.col("delegated_apply_group"), F.lit(f" is ready to apply for {family}."))
    return rest.select(
        F.col("request_id").alias("id"), F.lit("delegated_child_group").alias("kind"), F.lit(family).alias("family"), message.alias("message"),
        F.lit(True).alias("blocking"), F.struct(*groups.columns).alias("delegated_group"), F.lit(APPLY).alias("default_action"),
    )


def rejected_decisions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """(ord, request_id, action, reason, diagnostic) of apply decisions on unknown requests."""
    lost = decisions.filter(F.col("action") == APPLY).join(groups.select(request_id().alias("request_id")), "request_id", "left_anti")
    message = F.concat(F.lit("review decision "), F.col("request_id"), F.lit(" does not match any current delegated child review request."))
    told = F.struct(F.lit("error").alias("severity"), F.lit("replay_rejected").alias("category"), message.alias("message")).cast(DIAGNOSTIC)
    return lost.select("ord", "request_id", "action", F.lit("request_not_found").alias("reason"), told.alias("diagnostic"))


def apply_plan(groups: DataFrame, decisions: DataFrame, family: str) -> DataFrame:
    """(request_id, family, delegated_group, decision) of each accepted group with its first decision."""
    first = applied_decisions(groups, decisions).groupBy("request_id").agg(F.min_by(F.struct(*decisions.columns), "ord").alias("decision"))
    rows = groups.select(request_id().alias("request_id"), F.struct(*groups.columns).alias("delegated_group"))
    return rows.join(first, "request_id").select("request_id", F.lit(family).alias("family"), "delegated_group", "decision")


def replay_compatible(current: Column, candidate: Column) -> Column:
    """Whether two replay contexts struct<surface, families, require_explicit_contexts> agree, families in order."""
    same = lambda f: current[f].eqNullSafe(candidate[f])
    return candidate.isNotNull() & same("surface") & same("require_explicit_contexts") & same("families")


def family_decisions(families: DataFrame, decisions: DataFrame, prefix: str = "family_context:") -> DataFrame:
    """(family, outcome, decision) by the first decision on each family's request (ord, request_id, action,
    context_family): accepted_default, explicit, missing_required_payload or family_mismatch. A family
    without a telling decision has no row. families: (family, has_profile)."""
    d = decisions.join(families.select("family", "has_profile", F.concat(F.lit(prefix), F.col("family")).alias("request_id")), "request_id")
    explicit = F.col("action") == "provide_explicit_context"
    outcome = (
        F.when((F.col("action") == "accept_default_context") & F.col("has_profile"), "accepted_default")
        .when(explicit & F.col("context_family").isNull(), "missing_required_payload")
        .when(explicit & (F.col("context_family") != F.col("family")), "family_mismatch")
        .when(explicit, "explicit")
    )
    told = d.withColumn("outcome", outcome).filter("outcome is not null")
    return told.groupBy("family").agg(F.min_by(F.struct("outcome", F.struct(*decisions.columns).alias("decision")), "ord").alias("x")).select("family", "x.outcome", "x.decision")
