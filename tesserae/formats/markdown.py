"""Markdown by headings and fenced code."""

from __future__ import annotations

import re

from tesserae.contracts import failure
from tesserae.formats import trees

_HEADING = re.compile(r"(#{1,6})(?!#)\s+(.+?)\s*#*\s*\Z")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})\s*(.*?)\s*\Z")
_FAMILY = {"ts": "typescript", "typescript": "typescript", "rust": "rust", "rs": "rust", "go": "go", "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def lines_of(source: str) -> list[str]:
    """Lines, without empty ones at the end."""
    lines = re.split(r"\r\n?|\n", source)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def slugify(title: str) -> str:
    plain = re.sub(r"[`*_~\[\]()<>]", "", title.strip().lower())
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or "section"


def fence_family(info: str | None) -> tuple[str | None, str | None]:
    """(family, dialect) of a fence's info string."""
    word = (info or "").lower()
    family = _FAMILY.get(word)
    return family, ("jsonc" if word == "jsonc" else family)


def outline(lines: list[str]) -> list[dict]:
    """Headings and fences in order, each with its first line and, for a fence, its closing one."""
    found, headings, fences, at = [], 0, 0, 0
    while at < len(lines):
        if m := _HEADING.match(lines[at]):
            found.append({"path": f"/heading/{headings}", "owner_kind": "heading", "match_key": f"h{len(m[1])}:{slugify(m[2])}", "level": len(m[1]), "first": at, "last": at})
            headings += 1
        elif m := _FENCE.match(lines[at]):
            close = re.compile(rf"\s*{re.escape(m[1][0])}{{{len(m[1])},}}\s*\Z")
            last = next((k for k in range(at + 1, len(lines)) if close.match(lines[k])), max(at, len(lines) - 1))
            info = (m[2].split() or [""])[0]
            found.append({"path": f"/code_fence/{fences}", "owner_kind": "code_fence", "match_key": f"fence:{info or 'plain'}", "info_string": info or None, "first": at, "last": last})
            fences += 1
            at = last
        at += 1
    return found


def surfaces(owners: list[dict]) -> list[dict]:
    """The fences whose language is a family's."""
    out = []
    for o in owners:
        family, dialect = fence_family(o.get("info_string"))
        if o["owner_kind"] == "code_fence" and family:
            out.append({"surface_kind": "markdown_fenced_code_block", "declared_language": o["info_string"], "effective_language": dialect, "address": f"document[0] > fenced_code_block[{o['path']}]", "parent_address": "document[0]", "owner_kind": "structural_owner", "owner_address": o["path"], "reconstruction_strategy": "portable_write", "family": family})
    return out


def parse(source: str, dialect: str) -> dict:
    if dialect != "markdown":
        return failure("unsupported_feature", f"Unsupported Markdown dialect {dialect}.")
    owners = outline(lines_of(source))
    return {"ok": True, "diagnostics": [], "kind": "markdown", "dialect": dialect, "normalized_source": re.sub(r"\r\n?", "\n", source), "root_kind": "document", "owners": owners, "surfaces": surfaces(owners)}


def sections(source: str) -> list[tuple[str, str]]:
    """(path, text) from each owner to the next. What stands before the first belongs to none."""
    lines = lines_of(source)
    owners = outline(lines)
    ends = [*(o["first"] for o in owners), len(lines)][1:]
    return [(o["path"], "\n".join(lines[o["first"] : e]).strip()) for o, e in zip(owners, ends, strict=True)]


def merge(template: str, destination: str, dialect: str) -> dict:
    """The destination's sections, then those of the template whose place the destination lacks."""
    for side in (template, destination):
        if not (parsed := parse(side, dialect))["ok"]:
            return parsed
    there = sections(destination)
    paths = {p for p, _ in there}
    texts = [t for _, t in there] + [t for p, t in sections(template) if p not in paths]
    return trees.merged("\n\n".join(t for t in texts if t).strip() + "\n", policies=[])


def splice(source: str, outputs: dict[str, str]) -> dict:
    """source with the bodies of the fences at the given owner paths replaced, from the last upwards."""
    lines = lines_of(source)
    fences = {o["path"]: o for o in outline(lines) if o["owner_kind"] == "code_fence"}
    if missing := next((p for p in outputs if p not in fences), None):
        return failure("configuration_error", f"missing fenced-code range for {missing}")
    for path in sorted(outputs, key=lambda p: -fences[p]["first"]):
        body = outputs[path].removesuffix("\n").split("\n") if outputs[path] else []
        lines[fences[path]["first"] + 1 : fences[path]["last"]] = body
    return {"ok": True, "diagnostics": [], "output": "\n".join(lines).rstrip("\n") + "\n", "policies": []}
