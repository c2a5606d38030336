"""Transport envelopes: JSON of a kind, a version and one payload, written and read for whole columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
_EXECUTION = "structured_edit_provider_execution_"
_BATCH = "structured_edit_provider_batch_execution_"
_REPLAY = ("request", "application", "session", "workflow", "workflow_result", "workflow_apply_result", "workflow_apply_session", "workflow_apply_request", "workflow_review_request")

#: The payload's field by kind. Where it isn't the end of the kind's name, it stands here.
FIELDS: dict[str, str] = {
    **{_EXECUTION + k: f"execution_{k}" for k in ("request", "handoff", "invocation", "run_result", "receipt", "plan")},
    **{_BATCH + k: f"batch_execution_{k}" for k in ("request", "handoff", "invocation", "run_result", "receipt", "plan")},
    **{f"{_EXECUTION}receipt_replay_{k}": f"receipt_replay_{k}" for k in _REPLAY},
    **{f"{_BATCH}receipt_replay_{k}": f"batch_receipt_replay_{k}" for k in _REPLAY},
    **{_EXECUTION + k: f"provider_execution_{k}" for k in ("dispatch", "outcome", "application")},
    **{_EXECUTION + k: k for k in ("provenance", "replay_bundle")},
    **{_BATCH + k: f"batch_{k}" for k in ("dispatch", "outcome", "provenance", "replay_bundle", "report")},
    **{f"structured_edit_provider_executor_{k}": f"executor_{k}" for k in ("profile", "resolution", "registry")},
    "structured_edit_provider_executor_selection_policy": "selection_policy",
    "structured_edit_application": "application", "structured_edit_execution_report": "report", "structured_edit_batch_report": "batch_report",
    "conformance_manifest_review_state": "state", "review_replay_bundle": "replay_bundle", "reviewed_nested_execution": "execution",
    **{f"template_directory_session_{k}": k.rsplit("_", 1)[-1] for k in ("status", "diagnostics", "outcome", "request", "runner_request", "runner_payload", "inspection", "entrypoint", "command", "command_payload", "invocation")},
}


def export(payload: Column, kind: str) -> Column:
    """The envelope of each payload (a struct, map or array) as JSON. Null payload: null."""
    wrapped = F.struct(F.lit(kind).alias("kind"), F.lit(VERSION).alias("version"), payload.alias(FIELDS[kind]))
    return F.when(payload.isNotNull(), F.to_json(wrapped))


def read(envelope: Column, kind: str, payload: str) -> Column:
    """struct<payload, error struct<category, message>> of each envelope; payload is its type. The kind is
    checked first, then the version; a wrong one gives an error and no payload. Null: nulls."""
    head = F.from_json(envelope, "kind string, version int")
    error = (
        F.when(envelope.isNull(), F.lit(None))
        .when(~head["kind"].eqNullSafe(F.lit(kind)), F.struct(F.lit("kind_mismatch").alias("category"), F.lit(f"expected {kind} envelope kind.").alias("message")))
        .when(~head["version"].eqNullSafe(F.lit(VERSION)), F.struct(F.lit("unsupported_version").alias("category"), F.concat(F.lit(f"unsupported {kind} envelope version "), F.coalesce(head["version"].cast("string"), F.lit("")), F.lit(".")).alias("message")))
    )
    body = F.from_json(envelope, f"{FIELDS[kind]} {payload}")[FIELDS[kind]]
    return F.struct(F.when(error.isNull(), body).alias("payload"), error.alias("error"))
