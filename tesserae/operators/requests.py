"""Requests for sessions: from options, from named profiles, from payloads, entrypoints and commands.

The same rules exist twice: for one request as plain dictionaries, which `invoke` runs, and for tables of
requests as columns (`option_requests`, `profile_requests`, `payload_kinds`).
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import session

Options = Mapping[str, Any]
#: What a payload may say, and what stands in for what it doesn't.
DEFAULTS: dict[str, Any] = {"context": {}, "default_strategy": "merge", "overrides": [], "replacements": {}}
FIELDS = ("mode", "template_root", "destination_root", "context", "default_strategy", "overrides", "replacements", "allowed_families", "config")


def _mode(mode: object) -> str:
    return str(mode) if mode in session.MODES else "plan"


def _problem(reason: str, message: str) -> dict[str, str]:
    return {"severity": "error", "category": "configuration_error", "reason": reason, "message": message}


def _lacking(options: Options) -> list[dict[str, str]]:
    roots = ("destination_root", "template_root")
    return [_problem(f"missing_{r}", f"missing {r} for template session") for r in roots if not str(options.get(r) or "")]


def from_options(options: Options) -> dict[str, Any]:
    """request_kind, mode, ready, diagnostics by reason, and the options if nothing is missing."""
    lacking = _lacking(options)
    resolved = None if lacking else {k: v for k, v in options.items() if v is not None}
    return {"request_kind": "options", "mode": _mode(options.get("mode")), "ready": not lacking, "diagnostics": lacking, "resolved_options": resolved}


def from_profile(profiles: Mapping[str, Options], name: str, overrides: Options) -> dict[str, Any]:
    """As from_options, with what the overrides don't say taken from the profile. Roots are the overrides' alone."""
    profile = profiles.get(name)
    diagnostics = _lacking(overrides)
    if profile is None:
        diagnostics.append(_problem("missing_profile", f"unknown template session profile: {name}"))
    diagnostics.sort(key=lambda d: d["reason"])
    resolved = None
    if not diagnostics:
        shared = {f: overrides.get(f) or profile.get(f) for f in FIELDS if f not in ("template_root", "destination_root")}
        resolved = shared | {f: overrides.get(f) for f in ("template_root", "destination_root")}
        resolved = {k: v for k, v in resolved.items() if v is not None}
    mode = _mode(overrides.get("mode") or (profile or {}).get("mode"))
    return {"request_kind": "profile", "profile_name": name, "mode": mode, "ready": not diagnostics, "diagnostics": diagnostics, "resolved_options": resolved}


def payload_of(payload: Options) -> dict[str, Any]:
    """A payload with its kind (a profile's if it names one, options otherwise) and defaults filled in."""
    named = payload.get("profile_name") or payload.get("default_profile_name")
    mentioned = "profile_name" in payload or "default_profile_name" in payload
    out = {"request_kind": payload.get("request_kind") or ("profile" if mentioned else "options")}
    out |= {f: payload.get(f) or DEFAULTS.get(f) for f in FIELDS if f != "config"}
    return out | ({"profile_name": named} if named else {})


def runner_request(payload: Options) -> dict[str, Any]:
    """What the runner is asked by a whole payload: options, or a profile and only what differs from the defaults."""
    if payload["request_kind"] != "profile":
        return {"request_kind": "options", "options": {f: payload.get(f) for f in FIELDS if f != "config"}}
    said = {f: payload.get(f) for f in ("mode", "template_root", "destination_root")}
    if (payload.get("context") or {}).get("project_name"):
        said["context"] = payload["context"]
    if payload.get("default_strategy") not in (None, "merge"):
        said["default_strategy"] = payload["default_strategy"]
    said |= {f: payload[f] for f in ("overrides", "replacements") if payload.get(f)}
    if payload.get("allowed_families") is not None:
        said["allowed_families"] = payload["allowed_families"]
    return {"request_kind": "profile", "profile_name": payload.get("profile_name"), "overrides": said}


def entrypoint(source: Options) -> dict[str, Any]:
    """source_kind and runner_request of a payload or a request; neither asks for options that aren't there."""
    if source.get("payload"):
        return {"source_kind": "payload", "runner_request": runner_request(payload_of(source["payload"]))}
    if source.get("request"):
        return {"source_kind": "request", "runner_request": dict(source["request"])}
    return {"source_kind": "", "runner_request": {"request_kind": "options"}}


def resolve(source: Options, profiles: Mapping[str, Options] | None = None) -> dict[str, Any]:
    """An entrypoint with the session request that it comes to."""
    told = entrypoint(source)
    asked = told["runner_request"]
    if asked.get("request_kind") == "profile":
        return told | {"session_request": from_profile(profiles or {}, str(asked.get("profile_name")), asked.get("overrides") or {})}
    return told | {"session_request": from_options(asked.get("options") or {})}


def _request(options: Options) -> session.Request:
    overrides = tuple((o["path"], o["strategy"]) for o in options.get("overrides") or ())
    project = (options.get("context") or {}).get("project_name")
    return session.Request(
        _mode(options.get("mode")), options["template_root"], options["destination_root"], project, options.get("default_strategy") or "merge", overrides,
        options.get("replacements") or {}, tuple(options.get("allowed_families") or ()), config=options.get("config"),
    )


def inspect(spark: SparkSession, source: Options, profiles: Mapping[str, Options] | None = None) -> dict[str, Any]:
    """The resolution and, if the request is ready, the session as it would be planned; nothing is written."""
    told = resolve(source, profiles)
    asked = told["session_request"]
    planned = session.run(spark, _request(dict(asked["resolved_options"]) | {"mode": "plan"})) if asked["ready"] else None
    return told | {"mode": asked["mode"], "session": planned}


def invoke(spark: SparkSession, invocation: Options, profiles: Mapping[str, Options] | None = None) -> dict[str, Any]:
    """Carries out an invocation: operation inspect or run, with a payload, a request, or the payload's fields
    themselves. Another operation is an error."""
    operation = str(invocation.get("operation") or "")
    if operation not in ("inspect", "run"):
        raise ValueError(f"unsupported template directory session operation: {operation}")
    source = invocation if invocation.get("payload") or invocation.get("request") else {"payload": {k: v for k, v in invocation.items() if k != "operation"}}
    if operation == "inspect":
        return {"operation": operation, "inspection": inspect(spark, source, profiles), "outcome": None}
    asked = resolve(source, profiles)["session_request"]
    outcome = session.run(spark, _request(asked["resolved_options"])) if asked["ready"] else session.Session(None, None, None, 0, asked["diagnostics"])
    return {"operation": operation, "inspection": None, "outcome": outcome}


def _mode_of(mode: Column) -> Column:
    return F.when(mode.isin(*session.MODES), mode).otherwise("plan")


def _reasons(*also: Column) -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacking = [F.when(empty("destination_root"), "missing_destination_root"), *also, F.when(empty("template_root"), "missing_template_root")]
    return F.array_compact(F.array(*lacking))


def option_requests(options: DataFrame) -> DataFrame:
    """Options (mode, template_root, destination_root, ...) with resolved_mode, reasons in order, and ready."""
    told = options.withColumn("resolved_mode", _mode_of(F.col("mode"))).withColumn("reasons", _reasons())
    return told.withColumn("ready", F.size("reasons") == 0)


def profile_requests(overrides: DataFrame, profiles: DataFrame) -> DataFrame:
    """Overrides (profile_name, mode, template_root, destination_root, default_strategy) of profiles
    (profile_name, mode, default_strategy): resolved_mode, resolved_strategy, reasons in order, ready."""
    mine = profiles.select("profile_name", F.col("mode").alias("profile_mode"), F.col("default_strategy").alias("profile_strategy"), F.lit(True).alias("known"))
    rows = overrides.join(mine, "profile_name", "left")
    rows = rows.withColumn("resolved_mode", _mode_of(F.coalesce("mode", "profile_mode")))
    rows = rows.withColumn("reasons", _reasons(F.when(F.col("known").isNull(), "missing_profile"))).withColumn("ready", F.size("reasons") == 0)
    strategy = F.when(F.col("ready"), F.coalesce("default_strategy", "profile_strategy"))
    return rows.withColumn("resolved_strategy", strategy).drop("profile_mode", "profile_strategy", "known")


def payload_kinds(payloads: DataFrame) -> DataFrame:
    """Payloads (request_kind, profile_name, default_profile_name; null where not mentioned) with kind and name."""
    name = F.coalesce("profile_name", "default_profile_name")
    kind = F.when(F.coalesce(F.col("request_kind"), F.lit("")) != "", F.col("request_kind")).when(name.isNotNull(), "profile").otherwise("options")
    return payloads.withColumn("kind", kind).withColumn("name", name)
