"""Ruby by requires, classes, modules, methods and their documentation comments."""

from __future__ import annotations

import re

from tesserae.contracts import failure
from tesserae.formats import trees

_REQUIRE = re.compile(r"\s*require(?:_relative)?\s+[\"']([^\"']+)[\"']")
_OPENS = re.compile(r"\s*(?:(?:class|module)\s+([A-Z]\w*(?:::\w+)*)|def\s+(?:self\.)?([a-zA-Z_]\w*[!?=]?))", re.A)
_DIRECTIVE = re.compile(r":nocov:|[\w-]+:(?:freeze|unfreeze)", re.A)
_MAGIC = ("coding:", "encoding:", "frozen_string_literal:", "shareable_constant_value:", "typed:", "warn_indent:")
_EXAMPLE = re.compile(r"@example\b(.*)\Z", re.S)


def _content(raw: str) -> str:
    return re.sub(r"\A\s*#\s?", "", raw).strip()


def is_documentation(raw: str) -> bool:
    """Whether a comment line documents, rather than being empty, a directive or a magic comment."""
    text = _content(raw)
    return bool(text) and not _DIRECTIVE.fullmatch(text) and not text.startswith(_MAGIC)


def _name(line: str) -> str | None:
    m = _OPENS.match(line)
    return m and (m[1] or m[2])


def _walk(lines: list[str]):
    """(kind, index, value, comment lines right above) of requires and openings, line by line."""
    above: list[int] = []
    for k, line in enumerate(lines):
        if line.lstrip().startswith("#"):
            above.append(k)
            continue
        if m := _REQUIRE.match(line):
            yield "require", k, m[1], []
        elif name := _name(line):
            yield "declaration", k, name, above
        above = []


def surfaces(lines: list[str]) -> list[dict]:
    """Documentation comments of declarations, and the example blocks within."""
    out = []
    for kind, _, name, above in _walk(lines):
        doc = [k for k in above if is_documentation(lines[k])] if kind == "declaration" else []
        if not doc:
            continue
        address = f"document[0] > ruby_doc_comment[{name}]"
        prefix = re.match(r"\s*#\s*", lines[doc[0]])[0]
        common = {"reconstruction_strategy": "rewrite_with_prefix_preservation", "owner_kind": "owned_region", "comment_prefix": prefix}
        out.append(common | {"surface_kind": "ruby_doc_comment", "declared_language": "yard", "effective_language": "yard", "address": address, "parent_address": "document[0]", "owner_address": f"/declarations/{name}", "start_line": doc[0] + 1, "end_line": doc[-1] + 1})
        texts = [_content(lines[k]) for k in doc]
        for i, text in enumerate(texts):
            m = _EXAMPLE.match(text)
            stop = next((j for j in range(i + 1, len(texts)) if re.match(r"@[a-z_]+\b", texts[j])), len(texts))
            if m and i + 1 < stop:
                said = re.match(r"\[([^\]]+)\]", m[1].strip())
                language = said[1].lower().replace("-", "_") if said else "ruby"
                out.append(common | {"surface_kind": "yard_example_block", "declared_language": language, "effective_language": language, "address": f"{address} > yard_example[{i}]", "parent_address": address, "owner_address": address, "start_line": doc[i + 1] + 1, "end_line": doc[stop - 1] + 1})
    return out


def parse(source: str, dialect: str) -> dict:
    """Owners sorted by path as strings, so /requires/10 stands before /requires/2."""
    if dialect != "ruby":
        return failure("unsupported_feature", f"Unsupported Ruby dialect {dialect}.")
    plain = re.sub(r"\r\n?", "\n", source)
    owners, requires = [], 0
    for kind, _, value, _ in _walk(plain.split("\n")):
        owners.append({"path": f"/requires/{requires}" if kind == "require" else f"/declarations/{value}", "owner_kind": kind, "match_key": value})
        requires += kind == "require"
    return {"ok": True, "diagnostics": [], "kind": "ruby", "dialect": "ruby", "normalized_source": plain, "root_kind": "document", "owners": sorted(owners, key=lambda o: o["path"]), "surfaces": surfaces(plain.split("\n"))}


def declarations(source: str) -> list[tuple[str, str]]:
    """(path, text) of each outermost declaration with the comments above it. Depth counts classes,
    modules, methods and lines that are just `end`; other openings aren't counted."""
    lines = re.sub(r"\r\n?", "\n", source).split("\n")
    out, past = [], 0
    for kind, k, name, above in _walk(lines):
        if kind != "declaration" or k < past:
            continue
        depth, past = 1, k + 1
        while past < len(lines) and depth:
            depth += bool(_name(lines[past].strip())) - (lines[past].strip() == "end")
            past += 1
        out.append((f"/declarations/{name}", "\n".join(lines[min([k, *above]) : past]).strip()))
    return out


def merge(template: str, destination: str, dialect: str) -> dict:
    """The destination's requires and declarations, then the template's other declarations."""
    left, right = parse(template, dialect), parse(destination, dialect)
    if not left["ok"] or not right["ok"]:
        return left if not left["ok"] else trees.as_destination(right)
    requires = "\n".join(x.rstrip() for x in right["normalized_source"].split("\n") if _REQUIRE.match(x)).strip()
    there = declarations(destination)
    paths = {p for p, _ in there}
    texts = ([requires] if requires else []) + [t for _, t in there] + [t for p, t in declarations(template) if p not in paths]
    return trees.merged("\n\n".join(texts).strip() + "\n")


def splice(source: str, outputs: dict[str, str]) -> dict:
    """source with the lines of the surfaces at the given addresses replaced, each new line behind the
    surface's comment prefix, from the last upwards."""
    lines = re.sub(r"\r\n?", "\n", source).split("\n")
    known = {s["address"]: s for s in surfaces(lines)}
    if missing := next((a for a in outputs if a not in known), None):
        return failure("configuration_error", f"missing surface range for {missing}")
    for address in sorted(outputs, key=lambda a: -known[a]["start_line"]):
        s = known[address]
        body = outputs[address].removesuffix("\n").split("\n") if outputs[address] else []
        lines[s["start_line"] - 1 : s["end_line"]] = [(s["comment_prefix"] + x).rstrip() for x in body]
    return {"ok": True, "diagnostics": [], "output": "\n".join(lines).rstrip("\n") + "\n", "policies": []}
