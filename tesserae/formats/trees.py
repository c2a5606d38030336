"""What the families of nested keys and values share."""

from __future__ import annotations

import json
from collections.abc import Callable
from json.encoder import encode_basestring
from typing import Any

from tesserae.contracts import DESTINATION_WINS


def number(x: float | int) -> str:
    """A float has a fraction or an exponent with one, as in 1.0e+16."""
    if isinstance(x, int):
        return str(x)
    text = repr(x)
    head, e, tail = text.partition("e")
    return text if not e else f"{head if '.' in head else head + '.0'}e{tail if tail[0] in '+-' else '+' + tail}"


def dump(value: Any) -> str:
    """Compact JSON in the order of the keys."""
    if isinstance(value, str):
        return encode_basestring(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{dump(str(k))}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return number(value)


def overlay(template: Any, destination: Any) -> Any:
    """The destination's value, except that two mappings are joined by key, keys in order."""
    if not (isinstance(template, dict) and isinstance(destination, dict)):
        return destination
    both = template.keys() & destination.keys()
    return {k: overlay(template[k], destination[k]) if k in both else (destination if k in destination else template)[k] for k in sorted(template.keys() | destination.keys())}


def flatten(value: Any, kinds: Callable[[Any], str], item: str, deep: bool, path: str = "") -> list[dict]:
    """Owners by path in the order of keys. kinds names a key's owner by its value, item an array's
    element; deep: elements are looked into."""
    out = []
    if isinstance(value, dict):
        for k in sorted(value):
            out.append({"path": f"{path}/{k}", "owner_kind": kinds(value[k]), "match_key": k})
            out += flatten(value[k], kinds, item, deep, f"{path}/{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out.append({"path": f"{path}/{i}", "owner_kind": item})
            out += flatten(v, kinds, item, deep, f"{path}/{i}") if deep else []
    return out


def as_destination(result: dict) -> dict:
    """A failed parse, told as the destination's."""
    return {"ok": False, "policies": [], "diagnostics": [d | {"category": "destination_parse_error"} if d["category"] == "parse_error" else d for d in result["diagnostics"]]}


def merged(output: str, diagnostics: list[dict] | None = None, policies: list[dict] | None = None) -> dict:
    return {"ok": True, "diagnostics": diagnostics or [], "output": output, "policies": [DESTINATION_WINS] if policies is None else policies}
