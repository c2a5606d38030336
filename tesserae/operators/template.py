"""Planning, previewing and applying template trees, and the reports on it.

A tree is a DataFrame of files. A plan has a row for each template file and gains columns stage by
stage; all stages are projections and joins on a path. Columns: ord, template_source_path,
logical_destination_path, destination_path, classification, strategy, action, destination_exists, write_action,
token_keys, unresolved_token_keys, token_resolution_required, blocked, block_reason, template_content,
prepared_template_content, preparation_action, execution_action, ready, destination_content.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.contracts import DIAGNOSTIC, MERGE_RESULT
from tesserae.functions import structured
from tesserae.functions import template as T

#: Families that have a merge adapter unless others are given.
ADAPTERS = ("markdown", "ruby", "toml")


def plan_entries(template: DataFrame, project_name: str | None = None, default_strategy: str = "merge", overrides: DataFrame | None = None, omitted: tuple[str, ...] = ()) -> DataFrame:
    """Paths, classification and strategy of the files (ord, path, content). overrides: (ord, path,
    strategy); of those of one path the first counts. They are joined by path."""
    logical = T.logical_path(F.col("path"))
    rows = template.select("ord", F.col("path").alias("template_source_path"), logical.alias("logical_destination_path"), F.col("content").alias("template_content"))
    rows = rows.withColumn("destination_path", T.destination_path(F.col("logical_destination_path"), project_name, omitted))
    rows = rows.withColumn("classification", T.classify(F.coalesce("destination_path", "logical_destination_path")))
    if overrides is None:
        rows = rows.withColumn("strategy", F.lit(default_strategy))
    else:
        bare = lambda c: F.regexp_replace(c, r"\A\./", "")
        first = overrides.groupBy(bare("path").alias("override_path")).agg(F.min_by("strategy", "ord").alias("override"))
        rows = rows.join(first, bare("logical_destination_path") == first["override_path"], "left")
        rows = rows.withColumn("strategy", F.coalesce("override", F.lit(default_strategy))).drop("override", "override_path")
    return rows.withColumn("action", F.when(F.col("destination_path").isNull(), "omit").otherwise(F.col("strategy")))


def plan_execution(template: DataFrame, destination: DataFrame, project_name: str | None = None, default_strategy: str = "merge", overrides: DataFrame | None = None, replacements: Mapping[str, str] | None = None, omitted: tuple[str, ...] = (), config: Mapping[str, object] | None = None) -> DataFrame:
    """The whole plan of template files (ord, path, content) over destination files (path, content). omitted: logical
    paths that have no destination, such as a tool's own settings. config: how tokens look (functions.template.TOKENS)."""
    rows = plan_entries(template, project_name, default_strategy, overrides, omitted)
    there = destination.select(F.col("path").alias("destination_path"), F.col("content").alias("destination_content"), F.lit(True).alias("found"))
    rows = rows.join(there, "destination_path", "left").withColumn("destination_exists", F.coalesce("found", F.lit(False))).drop("found")
    none, strategy = F.col("destination_path").isNull(), F.col("strategy")
    write = F.when(none, "omit").when(strategy == "keep_destination", "keep").when(F.col("destination_exists"), "update").otherwise("create")
    keys = T.token_keys(F.col("template_content"), config)
    known = F.array(*[F.lit(k) for k in replacements or {}]).cast("array<string>")
    rows = rows.withColumn("write_action", write).withColumn("token_keys", keys).withColumn("unresolved_token_keys", F.array_except("token_keys", known))
    rows = rows.withColumn("token_resolution_required", ~none & ~strategy.isin("keep_destination", "raw_copy"))
    rows = rows.withColumn("blocked", F.col("token_resolution_required") & (F.size("unresolved_token_keys") > 0))
    content = F.coalesce("template_content", F.lit(""))
    required, blocked = F.col("token_resolution_required"), F.col("blocked")
    return rows.select(
        "*",
        F.when(blocked, "unresolved_tokens").alias("block_reason"),
        F.when(~blocked, F.when(required, T.resolve_tokens(content, dict(replacements or {}), config)).otherwise(content)).alias("prepared_template_content"),
        F.when(blocked, "blocked").when(required, "resolve_tokens").otherwise("pass_through").alias("preparation_action"),
        F.when(blocked, "blocked").when(none, "omit").when(F.col("write_action") == "keep", "keep").when(strategy == "raw_copy", "raw_copy")
        .when(strategy == "accept_template", "write_prepared_content").otherwise("merge_prepared_content").alias("execution_action"),
    ).withColumn("ready", ~F.col("execution_action").isin("blocked", "omit", "keep"))


def _written(output: Column) -> Column:
    same = F.col("destination_exists") & (F.col("destination_content") == output)
    return F.when(F.coalesce(same, F.lit(False)), "kept").when(F.col("destination_exists"), "updated").otherwise("created")


def preview(plan: DataFrame) -> DataFrame:
    """The plan with status and output of what can be told without merging; status is null where it
    can't. A merge shows only where there is no destination content."""
    action, prepared, there = F.col("execution_action"), F.col("prepared_template_content"), F.col("destination_content")
    status = (
        F.when(action == "blocked", F.when(F.col("destination_path").isNotNull(), "blocked"))
        .when(action == "omit", "omitted")
        .when(action == "keep", F.when(there.isNotNull(), "kept"))
        .when(action.isin("raw_copy", "write_prepared_content"), _written(prepared))
        .when(there.isNull(), F.when(F.col("destination_exists"), "updated").otherwise("created"))
    )
    output = F.when(action == "keep", there).when(action.isin("raw_copy", "write_prepared_content") | (action == "merge_prepared_content") & there.isNull(), prepared)
    return plan.select("*", status.alias("status"), output.alias("output"))


#: A merge of one's own: takes an entry (destination_path, family, dialect, prepared_template_content,
#: destination_content) and returns a dictionary with ok, and diagnostics, output and policies as far as there are any.
Merger = Callable[[dict], dict]


def _called(mergers: Mapping[str, Merger] | Merger) -> Column:
    """The MERGE_RESULT of each merge by mergers of one's own, by family or for all, in Arrow batches."""
    spark_type = structured.result_type(MERGE_RESULT)

    @F.arrow_udf(spark_type[0])
    def merged(entries: pa.Array) -> pa.Array:
        out = []
        for e in entries.to_pylist():
            merger = None if e is None else mergers if callable(mergers) else mergers[e["family"]]
            out.append(None if merger is None else {"ok": False, "diagnostics": [], "output": None, "policies": []} | merger(e))
        return pa.array(out, spark_type[1])

    entry = F.struct("destination_path", "classification.family", "classification.dialect", "prepared_template_content", "destination_content")
    here = (F.col("execution_action") == "merge_prepared_content") & F.col("destination_content").isNotNull()
    known = here if callable(mergers) else here & F.col("classification.family").isin(*mergers)
    return F.when(known, merged(F.when(known, entry)))


def _adapter_result(adapters: tuple[str, ...]) -> Column:
    """The MERGE_RESULT of each merge; only rows of the family are sent to its Python merger."""
    family, dialect = F.col("classification.family"), F.col("classification.dialect")
    out = None
    for name in adapters:
        for d in ("json", "jsonc") if name == "json" else (name,):
            here = (F.col("execution_action") == "merge_prepared_content") & F.col("destination_content").isNotNull() & (family == name) & (dialect == d)
            merged = structured.merge(F.when(here, F.col("prepared_template_content")), F.col("destination_content"), name, d)
            out = F.when(here, merged) if out is None else out.when(here, merged)
    message = F.concat(F.lit("missing family adapter for "), family)
    none = F.struct(
        F.lit(False).alias("ok"), F.array(F.struct(F.lit("error").alias("severity"), F.lit("configuration_error").alias("category"), message.alias("message"))).alias("diagnostics"),
        F.lit(None).cast("string").alias("output"), F.array().cast("array<struct<surface:string,name:string>>").alias("policies"),
    )
    merges = (F.col("execution_action") == "merge_prepared_content") & F.col("destination_content").isNotNull()
    return F.when(merges, none) if out is None else out.when(merges, none)


def apply(plan: DataFrame, adapters: tuple[str, ...] | Mapping[str, Merger] | Merger = ADAPTERS) -> DataFrame:
    """The plan with status, output and diagnostics of carrying it out. A merge that fails, or whose
    family has no adapter, is blocked and leaves its diagnostics. adapters: names of built-in ones, or mergers of
    one's own by family, or one for all merges."""
    own = callable(adapters) or isinstance(adapters, Mapping)
    merge = F.coalesce(_called(adapters), _adapter_result(())) if own else _adapter_result(adapters)
    rows = plan.withColumn("merge", merge)
    action, there = F.col("execution_action"), F.col("destination_content")
    failed = F.col("merge").isNotNull() & (~F.col("merge.ok") | F.col("merge.output").isNull())
    output = F.when(failed, F.lit(None)).when(F.col("merge").isNotNull(), F.col("merge.output")).when(action == "keep", there).when(F.col("ready"), F.col("prepared_template_content"))
    status = F.when(action == "omit", "omitted").when((action == "blocked") | failed, "blocked").when(action == "keep", F.when(there.isNotNull(), "kept").otherwise("created")).otherwise(_written(F.col("output")))
    rows = rows.withColumn("output", output).withColumn("status", status)
    return rows.withColumn("diagnostics", F.coalesce("merge.diagnostics", F.array().cast(f"array<{DIAGNOSTIC}>"))).drop("merge")


def convergence(plan: DataFrame) -> DataFrame:
    """(path) of what is pending: blocked files, and ready ones whose destination isn't yet the prepared
    template. No rows: converged."""
    same = F.coalesce(F.col("destination_content") == F.col("prepared_template_content"), F.lit(False))
    return plan.filter(F.col("blocked") | F.col("ready") & ~same).select(F.coalesce("destination_path", "logical_destination_path").alias("path"))


def plan_report(plan: DataFrame) -> DataFrame:
    """(template_source_path, logical_destination_path, destination_path, execution_action, write_action, status, previewable)."""
    action, create = F.col("execution_action"), F.col("write_action") == "create"
    status = F.when(action == "blocked", "blocked").when(action == "omit", "omitted").when(action == "keep", "keep").when(create, "create").otherwise("update")
    previewable = F.when(action == "blocked", False).when(action == "merge_prepared_content", create).otherwise(True)
    return plan.select("template_source_path", "logical_destination_path", "destination_path", "execution_action", "write_action", status.alias("status"), previewable.alias("previewable"))


def apply_report(applied: DataFrame) -> DataFrame:
    """(template_source_path, logical_destination_path, destination_path, execution_action, status, written)."""
    return applied.select("template_source_path", "logical_destination_path", "destination_path", "execution_action", "status", F.col("status").isin("created", "updated").alias("written"))


def summary(report: DataFrame, *statuses: str) -> DataFrame:
    """One row: how many rows have each status, and are written where the report says so."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return report.agg(*counts, *([F.count_if("written").alias("written")] if "written" in report.columns else []))


def adapter_capabilities(plan: DataFrame, adapters: tuple[str, ...] = ADAPTERS) -> DataFrame:
    """One row: required_families, adapter_families, missing_families, ready."""
    needed = F.array_sort(F.collect_set(F.when(F.col("execution_action") == "merge_prepared_content", F.col("classification.family"))))
    have = F.array(*[F.lit(a) for a in sorted(adapters)]).cast("array<string>")
    rows = plan.agg(needed.alias("required_families")).withColumn("adapter_families", have)
    return rows.withColumn("missing_families", F.array_except("required_families", "adapter_families")).withColumn("ready", F.size("missing_families") == 0)


def session_status(mode: str, plan: DataFrame, applied: DataFrame | None = None, adapters: tuple[str, ...] = ADAPTERS) -> DataFrame:
    """One row: mode, ready, missing_families, blocked_paths, planned_write_count, written_count."""
    if mode not in ("plan", "apply", "reapply"):
        raise ValueError(f"unsupported template session mode: {mode}")
    told = plan_report(plan).select("destination_path", "status", F.lit(False).alias("written"))
    if applied is not None:
        told = told.unionByName(apply_report(applied).select("destination_path", "status", "written"))
    counts = told.agg(
        F.array_sort(F.collect_set(F.when(F.col("status") == "blocked", F.col("destination_path")))).alias("blocked_paths"),
        F.count_if(F.col("status").isin("create", "update")).alias("planned_write_count"), F.count_if("written").alias("written_count"),
    )
    rows = adapter_capabilities(plan, adapters).crossJoin(counts)  # one row each
    return rows.select(F.lit(mode).alias("mode"), (F.col("ready") & (F.size("blocked_paths") == 0)).alias("ready"), "missing_families", "blocked_paths", "planned_write_count", "written_count")
