"""Records of structured edits, as struct columns.

A record nests columns under its fields, nothing is computed. Required fields must be given; optional
ones, and metadata, which every record may have, are left out when they aren't. `comment_region` of a selection is always there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Required fields | optional fields, by record.
RECORDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}


def _add(name: str, required: str, optional: str = "") -> None:
    RECORDS[name] = tuple(required.split()), (*optional.split(), "metadata")


_add("structure_profile", "owner_scope owner_selector known_owner_selector supported_comment_regions", "owner_selector_family")
_add("selection_profile", "owner_scope owner_selector selector_kind selection_intent known_selection_intent include_trailing_gap comment_anchored", "owner_selector_family selection_intent_family comment_region")
_add("match_profile", "start_boundary end_boundary payload_kind known_start_boundary known_end_boundary known_payload_kind comment_anchored trailing_gap_extended", "start_boundary_family end_boundary_family payload_family")
_add("operation_profile", "operation_kind known_operation_kind source_requirement destination_requirement replacement_source captures_source_text supports_if_missing", "operation_family")
_add("destination_profile", "resolution_kind resolution_source anchor_boundary resolution_family resolution_source_family anchor_boundary_family known_resolution_kind known_resolution_source known_anchor_boundary used_if_missing")
_add("request", "operation_kind content source_label", "target_selector target_selector_family destination_selector destination_selector_family payload_text if_missing")
_add("result", "operation_kind updated_content changed operation_profile", "captured_text match_count destination_profile")
_add("application", "request result")
_add("execution_report", "application provider_family diagnostics", "provider_backend")
_add("batch_request", "requests")
_add("batch_report", "reports diagnostics")
_add("execution_request", "request provider_family", "provider_backend")
_add("execution_application", "execution_request report")
_add("execution_dispatch", "execution_request resolved_provider_family resolved_provider_backend", "executor_label")
_add("execution_outcome", "dispatch application")
_add("execution_provenance", "dispatch outcome diagnostics")
_add("execution_replay_bundle", "execution_request provenance")
_add("executor_profile", "provider_family provider_backend executor_label structure_profile selection_profile match_profile operation_profiles destination_profile")
_add("executor_registry", "executor_profiles")
_add("executor_selection_policy", "provider_family selection_mode allow_registry_fallback", "provider_backend executor_label")
_add("executor_resolution", "executor_registry selection_policy selected_executor_profile")
_add("execution_plan", "execution_request executor_resolution")
_add("execution_handoff", "execution_plan execution_dispatch")
_add("execution_invocation", "execution_handoff")
_add("execution_run_result", "execution_invocation outcome")
_add("execution_receipt", "run_result", "provenance replay_bundle")
_add("receipt_replay_request", "execution_receipt replay_mode")
_add("receipt_replay_application", "receipt_replay_request run_result")
_add("receipt_replay_session", "receipt_replay_application execution_receipt")
_add("receipt_replay_workflow", "receipt_replay_session")
_add("receipt_replay_workflow_result", "receipt_replay_workflow receipt_replay_application")
_add("receipt_replay_workflow_review_request", "receipt_replay_workflow_result")
_add("receipt_replay_workflow_apply_request", "receipt_replay_workflow_review_request")
_add("receipt_replay_workflow_apply_session", "receipt_replay_workflow_apply_request receipt_replay_session")
_add("receipt_replay_workflow_apply_result", "receipt_replay_workflow_apply_session receipt_replay_workflow_result")
#: Batches: a record's name and the field that holds its array.
for _name, _field in {
    "execution_request": "requests", "execution_dispatch": "dispatches", "execution_outcome": "outcomes", "execution_provenance": "provenances", "execution_replay_bundle": "replay_bundles", "execution_plan": "plans",
    "execution_handoff": "handoffs", "execution_invocation": "invocations", "execution_run_result": "run_results", "execution_receipt": "receipts", "receipt_replay_request": "requests", "receipt_replay_application": "applications",
    "receipt_replay_session": "sessions", "receipt_replay_workflow": "workflows", "receipt_replay_workflow_result": "receipt_replay_workflow_results", "receipt_replay_workflow_review_request": "review_requests",
    "receipt_replay_workflow_apply_request": "apply_requests", "receipt_replay_workflow_apply_session": "apply_sessions", "receipt_replay_workflow_apply_result": "apply_results",
}.items():
    _add(f"batch_{_name}", _field)
_add("batch_execution_report", "applications diagnostics")
_add("surface", "surface_kind effective_language address owner reconstruction_strategy", "declared_language parent_address span")
_add("child_operation", "operation_id parent_operation_id requested_strategy language_chain surface")


def record(name: str, **fields: Column | str) -> Column:
    """The record of the given columns (names or expressions), its fields in the record's order."""
    required, optional = RECORDS[name]
    if missing := [f for f in required if f not in fields]:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    if unknown := [f for f in fields if f not in required + optional]:
        raise ValueError(f"{name} has no {', '.join(unknown)}")
    column = lambda f: (F.col(fields[f]) if isinstance(fields[f], str) else fields[f]).alias(f)
    out = [column(f) for f in (*required, *optional) if f in fields]
    if name == "selection_profile" and "comment_region" not in fields:
        out.append(F.lit(None).cast("string").alias("comment_region"))
    return F.struct(*out)


def batch(name: str, members: Column, **fields: Column | str) -> Column:
    """The batch record over an array of records."""
    return record(f"batch_{name}", **{RECORDS[f"batch_{name}"][0][0]: members}, **fields)
