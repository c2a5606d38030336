"""Parsers and mergers of single texts, by family; plain Python, applied in Arrow batches by
tesserae.functions.structured."""

from __future__ import annotations

from collections.abc import Callable

from tesserae.contracts import failure
from tesserae.formats import code, json_family, markdown, ruby, toml_family, yaml_family

Parser = Callable[[str, str], dict]
Merger = Callable[[str, str, str], dict]

#: (parser, merger) of each family: parse(source, dialect), merge(template, destination, dialect).
FAMILIES: dict[str, tuple[Parser, Merger]] = {
    "json": (json_family.parse, json_family.merge),
    "toml": (toml_family.parse, toml_family.merge),
    "yaml": (yaml_family.parse, yaml_family.merge),
    "markdown": (markdown.parse, markdown.merge),
    "ruby": (ruby.parse, ruby.merge),
    **{k: (code.parser(k), code.merger(k)) for k in ("typescript", "rust", "go")},
}

#: Alternative backends by family. They differ in the syntax gate only, so one parser serves them.
BACKENDS: dict[str, tuple[str, ...]] = {
    "json": ("language-pack",), "toml": ("language-pack", "citrus", "parslet"), "yaml": ("language-pack", "psych"),
    "markdown": ("language-pack", "kramdown", "commonmarker", "markly"), "ruby": ("language-pack", "prism"),
    "typescript": ("language-pack",), "rust": ("language-pack",), "go": ("language-pack",),
}


def _gate(family: str, dialect: str, backend: str | None) -> dict | None:
    if family not in FAMILIES:
        return failure("unsupported_feature", f"Unsupported family {family}.")
    if backend and backend not in BACKENDS[family]:
        return failure("unsupported_feature", f"Unsupported {family} backend {backend}.")
    if family == "json" and backend == "language-pack" and dialect != "json":
        return failure("unsupported_feature", "the language-pack backend parses the json dialect only.")
    return None


def parse(source: str | None, family: str, dialect: str, backend: str | None = None) -> dict | None:
    """The analysis of a text; None for None."""
    if source is None:
        return None
    return _gate(family, dialect, backend) or FAMILIES[family][0](source, dialect)


def merge(template: str | None, destination: str | None, family: str, dialect: str, backend: str | None = None) -> dict | None:
    """The merge of two texts; None if either is None."""
    if template is None or destination is None:
        return None
    return _gate(family, dialect, backend) or FAMILIES[family][1](template, destination, dialect)
