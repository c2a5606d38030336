"""A subset of YAML: block mappings, scalars (plain, quoted, literal and folded ones, of several lines too), and
flat sequences in block or flow form.

Anchors, aliases, tags and several documents are refused as parse errors; null values and nested sequences as
unsupported features.
"""

from __future__ import annotations

import json
import re

from tesserae.contracts import failure
from tesserae.formats import trees

_INT = re.compile(r"[-+]?(?:0|[1-9][0-9_]*)\Z")
_FLOAT = re.compile(r"[-+]?(?:[0-9][0-9_]*\.[0-9]*(?:[eE][-+]?[0-9]+)?|\.[0-9]+)\Z")
_WORDS = {**dict.fromkeys(("true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"), True), **dict.fromkeys(("false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"), False), **dict.fromkeys(("", "~", "null", "Null", "NULL"), None)}
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\[\]{}&*!|>%@`,?:-](?:[^#:]|:(?=\S)|(?<=\S)\#)*?|[-?:](?=\S)[^#:]*?)\s*:(?:\s+(.*))?\Z""", re.S)
_COMMENT = re.compile(r"""((?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^"'#]|(?<=\S)\#|(?<=\w)["'])*?)(?:(?:(?<=\s)|\A)\#.*)?\Z""", re.S)


class Unsupported(ValueError):
    pass


def scalar(text: str):
    """A plain or quoted scalar."""
    if text[:1] == '"':
        if not re.fullmatch(r'"(?:[^"\\]|\\.)*"', text, re.S):
            raise ValueError(f"unterminated quoted scalar {text}")
        return json.loads(text)
    if text[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text, re.S):
            raise ValueError(f"unterminated quoted scalar {text}")
        return text[1:-1].replace("''", "'")
    if text in _WORDS:
        return _WORDS[text]
    if _INT.match(text):
        return int(text.replace("_", ""))
    if re.fullmatch(r"0[0-7]+", text):
        return int(text, 8)
    if _FLOAT.match(text):
        return float(text.replace("_", ""))
    if text[:1] in "&*!|>%@`{}[]," or ": " in text or text.endswith(":"):
        raise ValueError(f"cannot read the scalar {text}")
    return text


def _flow(text: str) -> list:
    if not text.endswith("]"):
        raise ValueError(f"unterminated sequence {text}")
    inner = text[1:-1].strip()
    items = re.findall(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"'\[\]{}]+?)\s*(?:,|\Z)""", inner, re.S) if inner else []
    if inner and "[" in inner:
        raise Unsupported
    return [scalar(i) for i in items]


def _value(text: str):
    if text == "{}":
        return {}
    return _flow(text) if text.startswith("[") else scalar(text)


_BLOCK = re.compile(r"(?:(?:.*:\s|-\s)\s*|)([|>])([+-]?[1-9]?|[1-9][+-])\Z", re.S)


class _Text(str):
    """A value that was read whole already."""


def _block_text(lines: list[str], style: str, header: str) -> str:
    """A literal (|) or folded (>) scalar of raw lines."""
    said = re.search(r"[1-9]", header)
    full = [x for x in lines if x.strip(" ")]
    parent = min((len(x) - len(x.lstrip(" ")) for x in full), default=0)
    indent = parent if not said else min(parent, int(said[0]) + len(full[0]) - len(full[0].lstrip(" ")) if full else 0)
    rows = [x[indent:] if x.strip(" ") else "" for x in lines]
    end = len(rows)
    while end and not rows[end - 1]:
        end -= 1
    body, tail = rows[:end], len(rows) - end
    if style == ">":
        out, k = "", 0
        while k < len(body):
            out += body[k]
            gap = 0
            while k + 1 + gap < len(body) and not body[k + 1 + gap]:
                gap += 1
            if k + 1 + gap < len(body):
                kept = body[k][:1] in (" ", "\t") or body[k + 1 + gap][:1] in (" ", "\t") or not body[k]
                out += "\n" * (gap + 1) if kept else "\n" * gap or " "
            k += 1 + gap
    else:
        out = "\n".join(body)
    if "-" in header or not body and "+" not in header:
        return out
    return out + "\n" * (1 + tail if "+" in header and body else tail if "+" in header else 1)


def load(source: str) -> dict | list | str | None:
    lines, texts, every = [], {}, re.split(r"\r\n?|\n", source)
    ended = len(every) - (every[-1] == "")
    skipped = -1
    for number, raw in enumerate(every):
        if number <= skipped:
            continue
        m = _COMMENT.match(raw)
        text = (m[1] if m else raw).rstrip()
        block_at = _BLOCK.match(text.strip())
        if block_at:
            own = len(text) - len(text.lstrip(" "))
            skipped = number
            while skipped + 1 < ended and (not every[skipped + 1].strip(" ") or len(every[skipped + 1]) - len(every[skipped + 1].lstrip(" ")) > own):
                skipped += 1
            name = f"\0{number}"
            texts[name] = _Text(_block_text(every[number + 1 : skipped + 1], block_at[1], block_at[2]))
            text = text[: len(text) - len(block_at[1] + block_at[2])] + name
        if text.strip() and not (text == "---" and not lines):
            if text.strip("\t") != text.lstrip("\t").rstrip("\t") or "\t" in text[: len(text) - len(text.lstrip())]:
                raise ValueError("tabs cannot indent")
            lines.append((len(text) - len(text.lstrip(" ")), text.strip()))
    if not lines:
        return None
    at = 0

    def block(indent: int):
        nonlocal at
        if lines[at][1] == "-" or lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and (lines[at][1] == "-" or lines[at][1].startswith("- ")):
                text = lines[at][1][1:].strip()
                at += 1
                if (at < len(lines) and lines[at][0] > indent) or _KEY.match(text) or text.startswith(("- ", "[", "{")):
                    raise Unsupported
                items.append(texts[text] if text in texts else scalar(text))
            return items
        out: dict = {}
        while at < len(lines) and lines[at][0] == indent:
            m = _KEY.match(lines[at][1])
            if not m:
                raise ValueError(f"expected a key in {lines[at][1]}")
            key, rest = scalar(m[1].strip()), (m[2] or "").strip()
            at += 1
            deeper = at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and lines[at][1].startswith("- "))
            while rest and at < len(lines) and lines[at][0] > indent:  # a scalar that goes on
                if rest[0] in "[{\0" or rest[0] in "\"'" and rest[-1] == rest[0] and len(rest) > 1 or rest[0] not in "\"'" and _KEY.match(lines[at][1]):
                    raise ValueError(f"unexpected indentation at {lines[at][1]}")
                rest = f"{rest} {lines[at][1]}"
                at += 1
            out[key if isinstance(key, str) else trees.dump(key)] = texts.get(rest) if rest in texts else _value(rest) if rest or not deeper else block(lines[at][0])
        if at < len(lines) and lines[at][0] > indent:
            raise ValueError(f"unexpected indentation at {lines[at][1]}")
        return out

    if not _KEY.match(lines[0][1]) and not lines[0][1].startswith("-"):
        if len(lines) > 1:
            raise ValueError("expected a mapping")
        return texts.get(lines[0][1]) or _value(lines[0][1])
    value = block(lines[0][0])
    if at < len(lines):
        raise ValueError(f"unexpected {lines[at][1]}")
    return value


def _show(value) -> str:
    return value if isinstance(value, str) and re.fullmatch(r"[A-Za-z0-9_.-]+", value) else trees.dump(value)


def render(mapping: dict, indent: int = 0) -> str:
    """Keys in order; plain strings of word characters stay unquoted, whatever they mean when read again."""
    lines: list[str] = []

    def put(m: dict, pad: str) -> None:
        for k in sorted(m):
            v = m[k]
            lines.append(f"{pad}{k}:" if isinstance(v, (dict, list)) else f"{pad}{k}: {_show(v)}")
            if isinstance(v, dict):
                put(v, pad + "  ")
            elif isinstance(v, list):
                lines.extend(f"{pad}  - {_show(i)}" for i in v)

    put(mapping, " " * indent)
    return "\n".join(lines) + "\n"


def _plain(v) -> bool:
    return isinstance(v, (str, int, float))


def _bad(value, path: str) -> str | None:
    if isinstance(value, list) and not all(map(_plain, value)):
        return f"Unsupported YAML sequence value at {path or '/'}. Only scalar sequences are supported."
    if isinstance(value, dict):
        return next((b for k in sorted(value) if (b := _bad(value[k], f"{path}/{k}"))), None)
    return None if isinstance(value, list) or _plain(value) else f"Unsupported YAML value at {path or '/'}. Only mappings, scalar values, and scalar sequences are supported."


def parse(source: str, dialect: str) -> dict:
    if dialect != "yaml":
        return failure("unsupported_feature", f"Unsupported YAML dialect {dialect}.")
    try:
        root = load(source)
    except Unsupported:
        return failure("unsupported_feature", "Unsupported YAML sequence value. Only scalar sequences are supported.")
    except (ValueError, RecursionError) as e:
        return failure("parse_error", str(e))
    if not isinstance(root, dict):
        return failure("parse_error", "YAML documents must parse to a mapping root.")
    if bad := _bad(root, ""):
        return failure("unsupported_feature", bad)
    owners = trees.flatten(root, lambda v: "mapping" if isinstance(v, dict) else "key_value", "sequence_item", deep=False)
    return {"ok": True, "diagnostics": [], "kind": "yaml", "dialect": "yaml", "normalized_source": render(root), "root_kind": "mapping", "owners": owners}


def merge(template: str, destination: str, dialect: str) -> dict:
    """Both sides are read again from their canonical form before they are merged."""
    left, right = parse(template, dialect), parse(destination, dialect)
    if not left["ok"] or not right["ok"]:
        return left if not left["ok"] else trees.as_destination(right)
    try:
        both = load(left["normalized_source"]), load(right["normalized_source"])
    except ValueError as e:
        return failure("destination_parse_error", str(e))
    if not all(isinstance(b, dict) for b in both):
        return failure("parse_error", "YAML documents must parse to a mapping root.")
    return trees.merged(render(trees.overlay(*both)))
