"""JSON, and JSON with comments."""

from __future__ import annotations

import json
import re

from tesserae.contracts import DESTINATION_WINS, TRAILING_COMMA, diagnostic, failure
from tesserae.formats import trees

#: A string (also one that never ends), a line comment, a block comment (also unended), a trailing comma.
_STRING = r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)'
_COMMENT = re.compile(rf"({_STRING})|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_COMMA = re.compile(rf"({_STRING}|//[^\n]*\n?|/\*.*?(?:\*/|\Z))|,(\s*[\]}}])", re.S)


def _no(name: str) -> None:
    raise ValueError(f"{name} is no JSON value")


def strip_comments(source: str) -> str:
    """Comments outside strings go; a line comment leaves its line's end."""
    return _COMMENT.sub(lambda m: m[1] or "", source)


def has_trailing_comma(source: str) -> bool:
    return any(m[2] is not None for m in _COMMA.finditer(source))


def strip_trailing_commas(source: str) -> str:
    while (new := _COMMA.sub(lambda m: m[1] if m[1] is not None else m[2], source)) != source:
        source = new
    return source


def load(source: str):
    return json.loads(source, parse_constant=_no)


def parse(source: str, dialect: str) -> dict:
    """Dialects json and jsonc. Trailing commas are refused; of repeated keys the last counts."""
    plain = strip_comments(source) if dialect == "jsonc" else source
    if has_trailing_comma(plain):
        return failure("parse_error", f"Trailing commas are not supported for {dialect}.")
    try:
        value = load(plain)
    except (ValueError, RecursionError) as e:
        return failure("parse_error", str(e))
    root = "object" if isinstance(value, dict) else "array" if isinstance(value, list) else "scalar"
    owners = trees.flatten(value, lambda _: "member", "element", deep=True)
    return {"ok": True, "diagnostics": [], "kind": "json", "dialect": dialect, "allows_comments": dialect == "jsonc", "normalized_source": trees.dump(value), "root_kind": root, "owners": owners}


def merge(template: str, destination: str, dialect: str) -> dict:
    """Destination over template. A destination with trailing commas is tried once more without them."""
    left, right = parse(template, dialect), parse(destination, dialect)
    if not left["ok"]:
        return left
    notes, policies = [], [DESTINATION_WINS]
    if not right["ok"]:
        again = strip_trailing_commas(destination)
        retried = parse(again, dialect) if again != destination else right
        if not retried["ok"]:
            return trees.as_destination(right)
        right, policies = retried, [DESTINATION_WINS, TRAILING_COMMA]
        notes = [diagnostic("fallback_applied", "stripped trailing commas from destination before retrying json merge.", "warning")]
    return trees.merged(trees.dump(trees.overlay(load(left["normalized_source"]), load(right["normalized_source"]))), notes, policies)
