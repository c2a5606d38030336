"""Review of a whole conformance manifest: replay of decisions, contexts, planning and missing roles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.contracts import DIAGNOSTIC
from tesserae.operators import conformance, review

_PREFIX = "family_context:"


@dataclass(frozen=True)
class State:
    """Planned runs (with ref, requirements, profiles), diagnostics (reason, diagnostic), requests (id, family) and
    the decisions applied."""

    runs: DataFrame
    diagnostics: DataFrame
    requests: DataFrame
    applied_decisions: DataFrame


def replay_context(suites: DataFrame, require_explicit: bool) -> DataFrame:
    """One row: surface, families in the order of their selectors, require_explicit_contexts."""
    order = Window.orderBy("kind", "grammar", "variant")  # suites are few: one row a selector
    selectors = suites.select("kind", "grammar", "variant").distinct().withColumn("at", F.row_number().over(order))
    first = selectors.groupBy("grammar").agg(F.min("at").alias("at"))
    families = F.transform(F.array_sort(F.collect_list(F.struct("at", "grammar"))), lambda x: x["grammar"])
    return first.agg(families.alias("families")).select(F.lit("conformance_manifest").alias("surface"), "families", F.lit(require_explicit).alias("require_explicit_contexts"))


def accepted_decisions(suites: DataFrame, decisions: DataFrame, context: DataFrame | None, require_explicit: bool) -> tuple[DataFrame, DataFrame]:
    """(decisions to replay, diagnostics) of decisions (ord, request_id, action, context_family). Without a context, or
    with one that doesn't fit, none is; of others those on requests that there are now. context has one row."""
    told = lambda df, message, reason: df.select(F.lit(reason).alias("reason"), F.struct(F.lit("error").alias("severity"), F.lit("replay_rejected").alias("category"), message.alias("message")).cast(DIAGNOSTIC).alias("diagnostic"))
    if context is None:
        once = decisions.limit(1)  # one diagnostic for all
        return decisions.filter("false"), told(once, F.lit("review decisions were provided without replay context."), "missing_context")
    now = replay_context(suites, require_explicit).select(F.struct("*").alias("now"))
    fits = now.crossJoin(context.select(F.struct("surface", "families", "require_explicit_contexts").alias("then"))).select(review.replay_compatible(F.col("now"), F.col("then")).alias("fits"))
    judged = decisions.crossJoin(F.broadcast(fits))  # one row
    allowed = suites.select(F.concat(F.lit(_PREFIX), F.col("grammar")).alias("request_id")).distinct() if require_explicit else suites.select(F.lit("").alias("request_id")).filter("false")
    open_ones = judged.filter("fits").drop("fits")
    taken, stale = open_ones.join(allowed, "request_id", "left_semi"), open_ones.join(allowed, "request_id", "left_anti")
    misfit = judged.filter("not fits").limit(1)
    diagnostics = told(misfit, F.lit("review replay context does not match the current conformance manifest state."), "context_mismatch")
    message = F.concat(F.lit("review decision "), F.col("request_id"), F.lit(" does not match any current review request."))
    return taken.select(*decisions.columns), diagnostics.unionByName(told(stale, message, "request_not_found"))


def review_manifest(suites: DataFrame, families: DataFrame, contexts: DataFrame, profiles: DataFrame, decisions: DataFrame, context: DataFrame | None = None, require_explicit: bool = False) -> State:
    """Plans every suite whose family's context is given, assumed or decided, and tells what is in the way.

    contexts and profiles: (family, context / profile) with FAMILY_PROFILE structs. A suite with roles that the manifest
    doesn't have is left out, with a diagnostic.
    """
    taken, diagnostics = accepted_decisions(suites, decisions, context, require_explicit)
    wanted = suites.select(F.col("grammar").alias("family")).distinct()
    resolved = conformance.resolve_family_contexts(wanted, contexts, profiles, require_explicit)
    has = wanted.join(profiles.select("family", F.lit(True).alias("p")), "family", "left").select("family", F.coalesce("p", F.lit(False)).alias("has_profile"))
    decided = review.family_decisions(has, taken, _PREFIX) if require_explicit else None
    requests = wanted.filter("false").select(F.lit("").alias("id"), "family")
    applied = taken.filter("false")
    if decided is not None:
        by = resolved.join(decided, "family", "left").join(profiles.select("family", F.col("profile").alias("proposed")), "family", "left")
        open_family = F.col("context").isNull()
        accepted = F.coalesce(F.col("outcome").isin("accepted_default", "explicit"), F.lit(False))
        requests = by.filter(open_family & ~accepted & F.col("proposed").isNotNull()).select(F.concat(F.lit(_PREFIX), F.col("family")).alias("id"), "family")
        applied = by.filter(open_family & accepted).select("decision.*")
        note = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
        family, rid = F.col("family"), F.concat(F.lit(_PREFIX), F.col("family"))
        one = lambda severity, category, message: F.array(F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"))).cast(f"array<{DIAGNOSTIC}>")
        told = (
            F.when(~open_family, F.col("diagnostics"))
            .when(F.col("outcome") == "accepted_default", one("warning", "assumed_default", note("using default family context for ", family, ".")))
            .when(F.col("outcome") == "explicit", F.array().cast(f"array<{DIAGNOSTIC}>"))
            .when(F.col("outcome") == "missing_required_payload", one("error", "configuration_error", note("review decision ", rid, " requires explicit context payload.")))
            .when(F.col("outcome") == "family_mismatch", one("error", "configuration_error", note("review decision ", rid, " provided context for ", F.col("decision.context_family"), ", expected ", family, ".")))
            .when(F.col("proposed").isNull(), one("error", "configuration_error", note("missing family context for ", family, " and no default family profile is available.")))
            .otherwise(F.col("diagnostics"))
        )
        resolved = by.select("family", F.when(open_family & accepted, F.col("proposed")).otherwise(F.col("context")).alias("context"), told.alias("diagnostics"))
    diagnostics = diagnostics.unionByName(resolved.select(F.lit("family_context").alias("reason"), F.explode("diagnostics").alias("diagnostic")))
    planned = conformance.plan_suite(suites, families).join(resolved.filter("context is not null").select(F.col("family").alias("grammar"), F.col("context").alias("family_profile")), "grammar")
    suite = Window.partitionBy("kind", "grammar", "variant")
    planned = planned.withColumn("lacking", F.count_if("missing").over(suite))
    named = F.concat_ws("/", "kind", "grammar", "variant")
    roles = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("missing"), F.struct("ord", "role")))), lambda x: x["role"]), ", ")
    lost = planned.filter("lacking > 0").groupBy("kind", "grammar", "variant").agg(roles.alias("roles"))
    message = F.concat(F.lit("suite "), named, F.lit(" declares missing roles: "), F.col("roles"), F.lit("."))
    gone = lost.select(F.lit("missing_roles").alias("reason"), F.struct(F.lit("error").alias("severity"), F.lit("configuration_error").alias("category"), message.alias("message")).cast(DIAGNOSTIC).alias("diagnostic"))
    ref = F.struct(F.col("grammar").alias("family"), F.col("role"), F.col("role").alias("case"))
    runs = planned.filter("lacking = 0").select("kind", "grammar", "variant", "ord", ref.alias("ref"), "path", "requirements", "family_profile", F.lit(None).cast(conformance.FEATURE_PROFILE).alias("feature_profile"))
    return State(runs, diagnostics.unionByName(gone), requests, applied)


def report(state: State, execute: Callable[[pd.Series], tuple[str, list[str]]]) -> DataFrame:
    """(family, total, passed, failed, skipped) of running what is planned."""
    ran = conformance.run_suite(state.runs.select("ref", "requirements", "family_profile", "feature_profile"), execute)
    return conformance.summarize(ran.select(F.col("ref.family").alias("family"), "outcome"), "family")
