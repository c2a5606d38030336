"""A subset of TOML: basic strings, booleans, decimal integers and floats, flat arrays, dotted tables."""

from __future__ import annotations

import json
import re

from tesserae.contracts import failure
from tesserae.formats import trees

_QUOTED = r'"(?:[^"\\]|\\.)*"'
_LINE = re.compile(rf'((?:[^"#]|{_QUOTED})*)(#.*)?\Z', re.S)
_PIECE = re.compile(rf'{_QUOTED}|[^"]', re.S)
_PATH = r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*"
#: Lines as most are: a table's header, or a key with a number, a word or a string without escapes.
_HEADER = re.compile(rf"[ \t]*\[[ \t]*({_PATH})[ \t]*\][ \t]*(?:#.*)?\Z", re.A | re.S)
_ASSIGNMENT = re.compile(rf'[ \t]*({_PATH})[ \t]*=[ \t]*(?:"([^"\\\x00-\x1f]*)"|(-?\d{{1,18}})|(true|false))[ \t]*(?:#.*)?\Z', re.A | re.S)


def _fail(message: str) -> None:
    raise ValueError(message)


def _bare(line: str) -> str:
    m = _LINE.match(line)
    return m[1].strip() if m else _fail("Unterminated TOML string.")


def _split(text: str, separator: str) -> list[str]:
    """text at separators outside strings and brackets."""
    if not any(c in text for c in '"[]'):
        return [p.strip() for p in text.split(separator)]
    left, _, right = text.partition(separator)
    if '"' not in text and separator not in right and "[" not in left and "]" not in left and right.count("[") == right.count("]"):
        return [left.strip(), right.strip()] if len(left) < len(text) else [left.strip()]
    parts, depth = [[]], 0
    pieces = _PIECE.findall(text)
    if sum(map(len, pieces)) != len(text):
        _fail("Unterminated TOML string or array.")
    for p in pieces:
        depth += (p == "[") - (p == "]")
        if p == separator and depth == 0:
            parts.append([])
        else:
            parts[-1].append(p)
    if depth:
        _fail("Unterminated TOML string or array.")
    return ["".join(p).strip() for p in parts]


def _keys(text: str) -> list[str]:
    parts = [p.strip() for p in text.strip().rstrip(".").split(".")]
    if not text.strip():
        _fail("Missing TOML key path.")
    return parts if all(re.fullmatch(r"[A-Za-z0-9_-]+", p) for p in parts) else _fail(f"Unsupported TOML key path {text.strip()}.")


def _scalar(text: str):
    if re.fullmatch(r'".*"', text, re.S):
        try:
            return json.loads(text)
        except ValueError:
            _fail(f"Invalid TOML string {text}.")
    if text in ("true", "false"):
        return text == "true"
    if re.fullmatch(r"-?\d+", text, re.A):
        return int(text)
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text, re.A) else _fail(f"Unsupported TOML value {text}.")


def _value(text: str):
    if not text.startswith("["):
        return _scalar(text)
    if not text.endswith("]"):
        _fail(f"Invalid TOML array {text}.")
    inner = text[1:-1].strip()
    return [_scalar(p) for p in _split(inner, ",")] if inner else []


def _table(root: dict, path: list[str]) -> dict:
    for k in path:
        root = root.setdefault(k, {})
        if not isinstance(root, dict):
            _fail(f"TOML table path /{'/'.join(path)} conflicts with a value.")
    return root


def load(source: str) -> dict:
    root: dict = {}
    here: list[str] = []
    table = root
    for raw in re.split(r"\r\n?|\n", source):
        if not raw:
            continue
        if m := _ASSIGNMENT.match(raw):
            path = m[1].split(".")
            inner = _table(root, here + path[:-1]) if len(path) > 1 else table
            if isinstance(inner.get(path[-1]), dict):
                _fail(f"TOML key /{'/'.join(here + path)} conflicts with a table.")
            inner[path[-1]] = m[2] if m[2] is not None else int(m[3]) if m[3] is not None else m[4] == "true"
            continue
        if m := _HEADER.match(raw):
            here = m[1].split(".")
            table = _table(root, here)
            continue
        line = _bare(raw)
        if line.startswith("["):
            here = _keys(line[1:-1]) if line.endswith("]") else _fail(f"Invalid TOML table header {line}.")
            table = _table(root, here)
        elif line:
            parts = _split(line, "=")
            if len(parts) != 2:
                _fail(f"Invalid TOML assignment {line}.")
            path = here + _keys(parts[0])
            value, inner = _value(parts[1]), _table(root, path[:-1])
            if isinstance(inner.get(path[-1]), dict):
                _fail(f"TOML key /{'/'.join(path)} conflicts with a table.")
            inner[path[-1]] = value
    return root


def _show(value) -> str:
    return "[" + ", ".join(map(_show, value)) + "]" if isinstance(value, list) else trees.dump(value)


def render(table: dict) -> str:
    """Values before tables, keys in order, a blank line before each table but the first line."""
    lines: list[str] = []

    def put(t: dict, path: list[str]) -> None:
        if path:
            lines.extend(([""] if lines else []) + [f"[{'.'.join(path)}]"])
        lines.extend(f"{k} = {_show(t[k])}" for k in sorted(t) if not isinstance(t[k], dict))
        for k in sorted(t):
            if isinstance(t[k], dict):
                put(t[k], [*path, k])

    put(table, [])
    return "\n".join(lines) + "\n"


def parse(source: str, dialect: str) -> dict:
    if dialect != "toml":
        return failure("unsupported_feature", f"Unsupported TOML dialect {dialect}.")
    try:
        root = load(source)
    except ValueError as e:
        return failure("parse_error", str(e))
    owners = trees.flatten(root, lambda v: "table" if isinstance(v, dict) else "key_value", "array_item", deep=False)
    return {"ok": True, "diagnostics": [], "kind": "toml", "dialect": "toml", "normalized_source": render(root), "root_kind": "table", "owners": owners}


def _has_float(value) -> bool:
    if isinstance(value, (dict, list)):
        return any(map(_has_float, value.values() if isinstance(value, dict) else value))
    return isinstance(value, float)


def merge(template: str, destination: str, dialect: str) -> dict:
    """Destination over template. What is merged are the normalised texts; one without floats, which may be shown
    in a way that isn't read, says what was read, and so is neither shown nor read again."""
    if dialect != "toml":
        return parse(template, dialect)
    roots = []
    for source in (template, destination):
        try:
            roots.append(load(source))
        except ValueError as e:
            failed = failure("parse_error", str(e))
            return trees.as_destination(failed) if roots else failed
    try:
        left, right = (load(render(r)) if _has_float(r) else r for r in roots)
        return trees.merged(render(trees.overlay(left, right)))
    except ValueError as e:
        return failure("destination_parse_error", str(e))
