"""Sessions over directories: plan, apply and reapply a template tree, and the requests for it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import template
from tesserae.sources import checkpoints, trees

MODES = ("plan", "apply", "reapply")


@dataclass(frozen=True)
class Request:
    """What a session is asked; missing roots become diagnostics."""

    mode: str = "plan"
    template_root: str | None = None
    destination_root: str | None = None
    project_name: str | None = None
    default_strategy: str = "merge"
    overrides: tuple[tuple[str, str], ...] = ()
    replacements: Mapping[str, str] = field(default_factory=dict)
    allowed_families: tuple[str, ...] = ()
    omitted: tuple[str, ...] = ()
    config: Mapping[str, object] | None = None  # of tokens

    def normalized_mode(self) -> str:
        """An unknown mode in a request means plan."""
        return self.mode if self.mode in MODES else "plan"

    def diagnostics(self) -> list[dict]:
        told = [("template_root", self.template_root), ("destination_root", self.destination_root)]
        return [{"severity": "error", "category": "configuration_error", "reason": f"missing_{name}", "message": f"missing {name}."} for name, value in told if not value]


@dataclass(frozen=True)
class Session:
    """The plan, what was applied (for apply and reapply), the status row, and files written."""

    plan: DataFrame | None
    applied: DataFrame | None
    status: DataFrame | None
    written: int
    diagnostics: list[dict]


def adapters_for(allowed: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(a for a in template.ADAPTERS if not allowed or a in allowed)


def entry_diagnostics(plan: DataFrame, adapters: tuple[str, ...] = template.ADAPTERS) -> DataFrame:
    """(path, reason, family, message) of what keeps entries from being applied, in order: unresolved
    tokens, and merges whose family has no adapter."""
    path = F.coalesce("destination_path", "logical_destination_path")
    family = F.col("classification.family")
    blocked = plan.filter("blocked").select(path.alias("path"), F.lit("unresolved_tokens").alias("reason"), family.alias("family"), F.concat(F.lit("unresolved template tokens: "), F.array_join("unresolved_token_keys", ", ")).alias("message"))
    lacking = plan.filter((F.col("execution_action") == "merge_prepared_content") & ~family.isin(*adapters))
    lacking = lacking.select(path.alias("path"), F.lit("missing_family_adapter").alias("reason"), family.alias("family"), F.concat(F.lit("missing family adapter for "), family).alias("message"))
    return blocked.unionByName(lacking).orderBy("path", "reason", "family")


def run(spark: SparkSession, request: Request) -> Session:
    """Runs a session; a mode that isn't known is an error (requests of a kind in `requests` normalise it). plan reads only; apply and reapply write what they create or update. The applied
    plan is kept before it is written, since it reads the files it replaces."""
    if request.mode not in MODES:
        raise ValueError(f"unsupported template session mode: {request.mode}")
    problems = request.diagnostics()
    if problems:
        return Session(None, None, None, 0, problems)
    files = trees.read_tree(spark, request.template_root)
    numbered = files.select(F.struct("path").alias("ord"), "path", "content")
    overrides = spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(request.overrides)], "ord int, path string, strategy string") if request.overrides else None
    plan = template.plan_execution(numbered, trees.read_tree(spark, request.destination_root), request.project_name, request.default_strategy, overrides, request.replacements, request.omitted, request.config)
    adapters = adapters_for(request.allowed_families)
    if request.normalized_mode() == "plan":
        return Session(plan, None, template.session_status("plan", plan, None, adapters), 0, [])
    applied = checkpoints.keep(template.apply(plan, adapters))
    plan = applied.drop("output", "status", "diagnostics")
    written = trees.write_applied(applied, request.destination_root)
    return Session(plan, applied, template.session_status(request.mode, plan, applied, adapters), written, [])
