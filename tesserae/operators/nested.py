"""Merging with outputs for embedded texts: merge, find the surfaces, resolve outputs to them, splice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.contracts import DIAGNOSTIC
from tesserae.functions import structured


def operations(surfaces: DataFrame, family: str, pair: str = "pair_id") -> DataFrame:
    """(pair, ord, operation_id, parent_operation_id, requested_strategy, language_chain, surface) of
    surfaces (pair, ord, surface). A Ruby example's parent is its comment's operation."""
    order = Window.partitionBy(pair).orderBy("ord")
    kind, address = F.col("surface.surface_kind"), F.col("surface.address")
    root = f"{family}-document-0"
    if family == "markdown":
        named = surfaces.withColumn("operation_id", F.concat(F.lit("markdown-fence-"), (F.row_number().over(order) - 1).cast("string"))).withColumn("parent_operation_id", F.lit(root))
        chain = F.array(F.lit("markdown"), F.col("surface.effective_language"))
    else:
        example = kind == "yard_example_block"
        index = F.when(example, F.count_if(example).over(order) - 1).otherwise(F.row_number().over(order) - 1)
        named = surfaces.withColumn("operation_id", F.concat(F.when(example, "yard-example-").otherwise("ruby-doc-comment-"), index.cast("string")))
        parents = named.filter(~example).select(F.col(pair).alias("p"), address.alias("a"), F.col("operation_id").alias("parent"))
        named = named.join(parents, (F.col(pair) == F.col("p")) & (F.col("surface.parent_address") == F.col("a")), "left").withColumn("parent_operation_id", F.coalesce("parent", F.lit(root)))
        chain = F.when(example, F.array(F.lit("ruby"), F.lit("yard"), F.col("surface.effective_language"))).otherwise(F.array(F.lit("ruby"), F.col("surface.effective_language")))
    return named.select(pair, "ord", "operation_id", "parent_operation_id", F.lit("delegate_child_surface").alias("requested_strategy"), chain.alias("language_chain"), "surface")


def resolve_outputs(ops: DataFrame, outputs: DataFrame, prefix: str, default_family: str, pair: str = "pair_id") -> DataFrame:
    """outputs (pair, ord, surface_address, output) with request_id, family and the operation. missing: the
    pair's first address that no surface has; then nothing of the pair is applied."""
    o = ops.select(pair, F.col("surface.address").alias("surface_address"), F.struct("operation_id", "parent_operation_id", "surface").alias("operation"))
    rows = outputs.join(o, [pair, "surface_address"], "left")
    lost = F.min_by(F.when(F.col("operation").isNull(), F.col("surface_address")), F.when(F.col("operation").isNull(), F.col("ord"))).over(Window.partitionBy(pair))
    index = F.row_number().over(Window.partitionBy(pair).orderBy("ord")) - 1
    return rows.select("*", lost.alias("missing"), F.concat(F.lit(f"{prefix}:"), index.cast("string")).alias("request_id"), F.coalesce("operation.surface.family", F.lit(default_family)).alias("family"))


def _failed(category: str, message: Column) -> Column:
    told = F.array(F.struct(F.lit("error").alias("severity"), F.lit(category).alias("category"), message.alias("message")))
    return F.struct(F.lit(False).alias("ok"), told.alias("diagnostics"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("array<struct<surface:string,name:string>>").alias("policies"))


def merge_with_outputs(pairs: DataFrame, outputs: DataFrame, family: str, pair: str = "pair_id") -> DataFrame:
    """(pair, result) of pairs (pair, template, destination), with outputs (pair, ord, surface_address,
    output) put into the merged text. A failed merge, an address that no surface has, or a failed splice is
    the result. Pairs without outputs are just merged."""
    merged = pairs.select(pair, structured.merge(F.col("template"), F.col("destination"), family).alias("merged"))
    found = merged.filter("merged.ok").select(pair, structured.analyze(F.col("merged.output"), family).alias("analysis"))
    surfaces = found.select(pair, F.posexplode("analysis.surfaces").alias("ord", "surface"))
    resolved = resolve_outputs(operations(surfaces, family, pair), outputs, f"nested_{family}_child", family, pair)
    key = F.col("operation.surface.owner_address") if family == "markdown" else F.col("surface_address")
    last = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("operation").isNotNull(), F.struct(key, "output")))))
    one = resolved.withColumn("again", F.row_number().over(Window.partitionBy(pair, "surface_address").orderBy(F.desc("ord")))).filter("again = 1")
    put = one.groupBy(pair).agg(F.first("missing").alias("missing"), last.alias("outputs"))
    rows = merged.join(put, pair, "left")
    missing = F.concat(F.lit("missing delegated child surface "), F.col("missing"), F.lit("."))
    done = structured.splice(F.when(F.col("merged.ok") & F.col("missing").isNull() & F.col("outputs").isNotNull(), F.col("merged.output")), F.col("outputs"), family)
    result = F.when(~F.col("merged.ok") | F.col("outputs").isNull(), F.col("merged")).when(F.col("missing").isNotNull(), _failed("configuration_error", missing)).otherwise(done)
    return rows.select(pair, result.alias("result"))


def merge_with_review(pairs: DataFrame, plan: DataFrame, applied: DataFrame, family: str, pair: str = "pair_id") -> DataFrame:
    """As merge_with_outputs, but with the outputs of accepted groups: plan (pair, ord, child_operation_id)
    and applied (pair, operation_id, output). Entries without an operation or output are passed over."""
    merged = pairs.select(pair, structured.merge(F.col("template"), F.col("destination"), family).alias("merged"))
    found = merged.filter("merged.ok").select(pair, F.posexplode(structured.analyze(F.col("merged.output"), family)["surfaces"]).alias("ord", "surface"))
    ops = operations(found, family, pair).select(pair, "operation_id", F.col("surface.address").alias("surface_address"))
    chosen = plan.select(pair, F.col("ord"), F.col("child_operation_id").alias("operation_id")).join(ops, [pair, "operation_id"]).join(applied, [pair, "operation_id"])
    return merge_with_outputs(pairs, chosen.select(pair, "ord", "surface_address", "output"), family, pair)


def diagnostics_of(results: DataFrame, pair: str = "pair_id") -> DataFrame:
    """(pair, diagnostic) of results (pair, result)."""
    return results.select(pair, F.explode(F.col("result.diagnostics").cast(f"array<{DIAGNOSTIC}>")).alias("diagnostic"))
