"""Planning, selecting, running and reporting a conformance suite.

A manifest is three tables: families (ord, family, role, path, requirements), suites (kind, grammar,
variant, roles) and profiles. Requirements and profiles are structs:
requirements struct<backend, dialect, policies: array<struct<surface, name>>>,
family_profile struct<family, supported_dialects, supported_policies>,
feature_profile struct<backend, supports_dialects, supported_policies>.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.contracts import DIAGNOSTIC, POLICY

REQUIREMENTS = f"struct<backend:string,dialect:string,policies:array<{POLICY}>>"
FAMILY_PROFILE = f"struct<family:string,supported_dialects:array<string>,supported_policies:array<{POLICY}>>"
FEATURE_PROFILE = f"struct<backend:string,supports_dialects:boolean,supported_policies:array<{POLICY}>>"
REF = "struct<family:string,role:string,case:string>"


def suite_selectors(suites: DataFrame) -> DataFrame:
    """The distinct (kind, grammar, variant) in order."""
    return suites.select("kind", "grammar", "variant").distinct().orderBy("kind", "grammar", "variant")


def suite_definition(suites: DataFrame, selectors: DataFrame) -> DataFrame:
    """The first suite (by ord) of each selector; variants match null by null."""
    s = selectors.select(F.col("kind").alias("k"), F.col("grammar").alias("g"), F.col("variant").alias("v"))
    joined = suites.join(s, (F.col("kind") == F.col("k")) & (F.col("grammar") == F.col("g")) & F.col("variant").eqNullSafe(F.col("v")))
    first = F.row_number().over(Window.partitionBy("kind", "grammar", "variant").orderBy("ord"))
    return joined.withColumn("first", first).filter("first = 1").select(*suites.columns)


def plan_suite(suites: DataFrame, families: DataFrame) -> DataFrame:
    """(kind, grammar, variant, ord, role, path, requirements, missing) of each role of each suite: the
    manifest's first entry for it, or missing."""
    roles = suites.select("kind", "grammar", "variant", F.posexplode("roles").alias("ord", "role"))
    first = families.groupBy(F.col("family").alias("grammar"), "role").agg(F.min_by(F.struct("path", "requirements"), "ord").alias("entry"))
    rows = roles.join(first, ["grammar", "role"], "left")
    return rows.select("kind", "grammar", "variant", "ord", "role", "entry.path", "entry.requirements", F.col("entry").isNull().alias("missing"))


def selection_messages(requirements: Column, family: Column, feature: Column) -> Column:
    """Why a case can't run, in order: the backend, the dialect, then each policy. Empty: it can."""
    name, backend, dialect = family["family"], requirements["backend"], requirements["dialect"]
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    no_feature = feature.isNull()
    about_backend = F.when(
        backend.isNotNull(),
        F.when(no_feature, say("case requires backend ", backend, " but no backend feature profile is available for family ", name, "."))
        .when(~backend.eqNullSafe(feature["backend"]), say("case requires backend ", backend, " but backend ", feature["backend"], " is active for family ", name, ".")),
    )
    known = F.array_contains(F.coalesce(family["supported_dialects"], F.array().cast("array<string>")), dialect)
    about_dialect = F.when(
        dialect.isNotNull(),
        F.when(~known, say("family ", name, " does not support dialect ", dialect, "."))
        .when(~no_feature & ~F.coalesce(feature["supports_dialects"], F.lit(False)) & (dialect != name), say("backend ", feature["backend"], " does not support dialect ", dialect, " for family ", name, ".")),
    )
    none = F.array().cast(f"array<{POLICY}>")
    about_policies = F.transform(
        F.coalesce(requirements["policies"], none),
        lambda p: F.when(~F.array_contains(F.coalesce(family["supported_policies"], none), p), say("family ", name, " does not support policy ", p["name"], "."))
        .when(~no_feature & ~F.array_contains(F.coalesce(feature["supported_policies"], none), p), say("backend ", feature["backend"], " does not support policy ", p["name"], ".")),
    )
    return F.array_compact(F.concat(F.array(about_backend, about_dialect), about_policies))


def select_cases(runs: DataFrame) -> DataFrame:
    """runs (ref, requirements, family_profile, feature_profile, ...) with status and messages."""
    messages = selection_messages(F.col("requirements"), F.col("family_profile"), F.col("feature_profile"))
    return runs.withColumn("messages", messages).withColumn("status", F.when(F.size("messages") == 0, "selected").otherwise("skipped"))


def run_suite(runs: DataFrame, execute: Callable[[dict], tuple[str, list[str]]]) -> DataFrame:
    """(ref, outcome, messages) of each run; execute is called on selected runs only, in batches on the
    executors, and returns (outcome, messages)."""
    chosen = select_cases(runs)

    def executed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [execute(row) for row in batch.to_dict("records")]
            yield pd.DataFrame({"ref": batch["ref"], "outcome": [d[0] for d in done], "messages": [list(d[1]) for d in done]})

    skipped = chosen.filter("status = 'skipped'").select("ref", F.lit("skipped").alias("outcome"), "messages")
    return chosen.filter("status = 'selected'").mapInPandas(executed, f"ref {REF}, outcome string, messages array<string>").unionByName(skipped)


def summarize(results: DataFrame, *by: str) -> DataFrame:
    """total, passed, failed, skipped; another outcome counts in the total only."""
    counts = [F.count("*").alias("total"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped"))]
    return results.groupBy(*by).agg(*counts) if by else results.agg(*counts)


def sum_summaries(summaries: DataFrame) -> DataFrame:
    """One row: the sums of total, passed, failed, skipped."""
    return summaries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "passed", "failed", "skipped")])


def _diagnostic(severity: str, category: str, *parts: str | Column) -> Column:
    message = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"))


def resolve_family_contexts(families: DataFrame, contexts: DataFrame, profiles: DataFrame, require_explicit: bool = False) -> DataFrame:
    """(family, context, assumed, diagnostics): the explicit context of contexts (family, context), else, unless
    explicit ones are required, the profile of profiles (family, profile) as an assumed default."""
    c = contexts.select("family", F.col("context").alias("explicit"), F.lit(True).alias("given"))
    p = profiles.select("family", F.col("profile").alias("default_profile"))
    rows = families.select("family").distinct().join(c, "family", "left").join(p, "family", "left")
    given, default = F.coalesce("given", F.lit(False)), F.col("default_profile").isNotNull()
    family = F.col("family")
    problem = (
        F.when(given, F.lit(None))
        .when(F.lit(require_explicit), _diagnostic("error", "configuration_error", "missing explicit family context for ", family, "."))
        .when(default, _diagnostic("warning", "assumed_default", "using default family context for ", family, "."))
        .otherwise(_diagnostic("error", "configuration_error", "missing family context for ", family, " and no default family profile is available."))
    )
    assumed = ~given & F.lit(not require_explicit) & default
    found = F.when(given, F.col("explicit")).when(assumed, F.col("default_profile"))
    return rows.select("family", found.alias("context"), assumed.alias("assumed"), F.array_compact(F.array(problem)).cast(f"array<{DIAGNOSTIC}>").alias("diagnostics"))
