"""TypeScript, Rust and Go by their imports and top-level declarations.

There is no grammar here: a scanner skips strings and comments, counts brackets and finds the
statements of the outermost level. Brackets that don't match are a parse error. Statements of no known
form are left out, as nameless ones are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from tesserae.contracts import failure
from tesserae.formats import trees

_COMMON = r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\%s]|\\.)*"|`(?:[^`\\]|\\.)*`|"""
#: Comments and strings. Rust's strings may have several lines, and an apostrophe alone is a lifetime.
_SKIP = {
    # a slash where a value is expected begins a regular expression
    "typescript": re.compile(_COMMON % r"\n" + r"'(?:[^'\\\n]|\\.)*'|(?P<before>[=(,:\[!&|?{};+~<>*%-]\s*|\b(?:return|typeof|case|in|of)\s+)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*", re.S),
    "rust": re.compile(_COMMON % "" + r"'(?:\\[^'\n]+|[^'\\\n])'", re.S),
    "go": re.compile(_COMMON % r"\n" + r"'(?:\\[^'\n]+|[^'\\\n])'", re.S),
}
_IMPORT = {
    "typescript": re.compile(r"import\b"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?use\b"),
    "go": re.compile(r"import\b"),
}
_NAMED = {
    "typescript": re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|enum|namespace|module|type|const|let|var)\s+([A-Za-z_$][\w$]*)"),
    "rust": re.compile(r"(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+|unsafe\s+|async\s+|const\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?:fn|struct|enum|trait|mod|union|type|static|const|impl(?:<[^>]*>)?)\s+([A-Za-z_]\w*)"),
    "go": re.compile(r"(?:func\s+(?:\([^)]*\)\s*)?|type\s+|var\s+|const\s+)([A-Za-z_]\w*)"),
}


def _statements(kind: str, source: str) -> list[str]:
    """Source texts of the outermost statements: each ends at a semicolon, at its closing brace, or at a
    line's end where nothing is open and the next line doesn't go on with it."""
    def blanked(m: re.Match) -> str:
        before = m.groupdict().get("before") or ""
        rest = m[0][len(before) :]
        return before + re.sub(r"[^\n]", " " if rest[:2] in ("//", "/*") else "_", rest)

    blank = _SKIP[kind].sub(blanked, source)
    out, depth, start = [], [], 0
    closing = {")": "(", "]": "[", "}": "{"}

    def end(stop: int) -> None:
        nonlocal start
        if blank[start:stop].strip():
            lead = len(blank[start:stop]) - len(blank[start:stop].lstrip())
            out.append(source[start + lead : stop].rstrip())
        start = stop

    for k, c in enumerate(blank):
        if c in "([{":
            depth.append(c)
        elif c in closing:
            if not depth or depth.pop() != closing[c]:
                raise ValueError(f"unexpected {c} at {k}")
            if c == "}" and not depth and not re.match(r"[ \t]*(?:from\b|;|,|\)|\.|as\b|=)", blank[k + 1 :]):
                end(k + 1)
        elif c == ";" and not depth:
            end(k + 1)
        elif c == "\n" and not depth:
            line = blank[start:k].strip()
            if line and not re.search(r"(?:[=,+\-*/|&.<(]|\belse|\bfrom)$", line) and not re.match(r"\s*(?:[.{=|&?:]|from\b|where\b|extends\b|implements\b)", blank[k + 1 :]) and not line.startswith(("#[", "@")):
                end(k)
    if depth:
        raise ValueError(f"{depth[-1]} is never closed")
    end(len(source))
    return out


def _import_entries(kind: str, text: str) -> list[tuple[str, str]]:
    """(match key, text) of an import statement. Of a group in Go, each line is one."""
    if kind == "rust":
        return [(re.sub(r"\s*;$", "", re.sub(r"^(?:pub(?:\([^)]*\))?\s+)?use\s+", "", text)).strip(), text)]
    quoted = re.findall(r"[\"'`]([^\"'`]+)[\"'`]", text)
    if kind == "go" and re.match(r"import\s*\(", text):
        return [(q, x.strip()) for x in text.split("\n") for q in re.findall(r"[\"`]([^\"`]+)[\"`]", x)]
    return [(quoted[-1] if quoted else re.sub(r"^import\s+", "", text).rstrip(";").strip(), text)]


def analyse(kind: str, source: str) -> tuple[list[dict], list[dict]]:
    """(imports, declarations), each with path, match_key and text. Of Go imports of one path the longest
    text counts, at the place of the first; declarations are sorted by path."""
    imports: dict = {}
    found = []
    for text in _statements(kind, source):
        if _IMPORT[kind].match(text):
            for key, part in _import_entries(kind, text):
                at = key if kind == "go" else len(imports)
                if at not in imports or len(part) > len(imports[at][1]):
                    imports[at] = (key, part)
        elif m := _NAMED[kind].match(text):
            found.append({"path": f"/declarations/{m[1]}", "match_key": m[1], "text": text.strip() + "\n"})
    listed = [{"path": f"/imports/{i}", "match_key": k, "text": t.strip() + "\n"} for i, (k, t) in enumerate(imports.values())]
    return listed, sorted(found, key=lambda d: d["path"])


def parser(kind: str) -> Callable[[str, str], dict]:
    def parse(source: str, dialect: str) -> dict:
        if dialect != kind:
            return failure("unsupported_feature", f"Unsupported {kind} dialect {dialect}.")
        try:
            imports, declarations = analyse(kind, source)
        except ValueError as e:
            return failure("parse_error", str(e))
        owners = [{"path": x["path"], "owner_kind": o, "match_key": x["match_key"]} for o, part in (("import", imports), ("declaration", declarations)) for x in part]
        return {"ok": True, "diagnostics": [], "kind": kind, "dialect": kind, "normalized_source": source, "root_kind": "document", "owners": owners}

    return parse


def merger(kind: str) -> Callable[[str, str, str], dict]:
    def merge(template: str, destination: str, dialect: str) -> dict:
        """The destination's imports and declarations, then the template's other declarations."""
        left, right = parser(kind)(template, dialect), parser(kind)(destination, dialect)
        if not left["ok"] or not right["ok"]:
            return left if not left["ok"] else trees.as_destination(right)
        (_, ours), (imports, theirs) = analyse(kind, template), analyse(kind, destination)
        paths = {d["path"] for d in theirs}
        body = "\n".join([d["text"] for d in theirs] + [d["text"] for d in ours if d["path"] not in paths]).rstrip()
        parts = ["".join(i["text"] for i in imports).rstrip(), body]
        return trees.merged("\n\n".join(p for p in parts if p).rstrip() + "\n")

    return merge
