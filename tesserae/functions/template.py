"""Native column functions over template paths and tokens; all stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How tokens look unless something else is said: words in braces, the first two divided by |, later ones by :.
TOKENS = {"pre": "{", "post": "}", "separators": ("|", ":"), "min_segments": 2, "max_segments": None, "segment_pattern": "[A-Za-z0-9_]"}


def token_pattern(config: Mapping[str, object] | None = None) -> tuple[str, int, int]:
    """(pattern, characters before a token's key, characters behind it) of a configuration over TOKENS: pre and post, separators
    (the last one divides all later segments), the least and most segments, and a segment's character class."""
    c = TOKENS | {k: v for k, v in (config or {}).items() if v is not None}
    one = str(c["segment_pattern"])
    segment = f"{one}+" if one.startswith("[") and one.endswith("]") else f"(?:{one})+"
    separators, least, most = tuple(c["separators"]), int(c["min_segments"]), c["max_segments"]
    if least < 1 or most is not None and most < least or not separators:
        raise ValueError("tokens need a separator and segments from one up to the most")
    pattern, opened, k = segment, 0, 1
    while k < max(least, len(separators)) and (most is None or k < most):  # each with a separator of its own
        pattern += ("" if k < least else "(?:") + re.escape(separators[min(k, len(separators)) - 1]) + segment
        opened += k >= least
        k += 1
    if most is None or k < most:
        pattern += f"(?:{re.escape(separators[-1])}{segment})" + ("*" if most is None else f"{{0,{most - k}}}")
    return re.escape(c["pre"]) + pattern + ")?" * opened + re.escape(c["post"]), len(c["pre"]), len(c["post"])


TOKEN = token_pattern()[0]


def logical_path(path: Column) -> Column:
    """The path without one example suffix."""
    return F.regexp_replace(path, r"(\.no-osc)?\.example\z", "")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, r"\A\./", "")


def classify(path: Column) -> Column:
    """struct(destination_path, file_type, family, dialect) by the first rule that fits."""
    plain = _plain(path)
    base = F.regexp_extract(plain, r"([^/]*)/*\z", 1)
    low, low_base = F.lower(plain), F.lower(base)
    ends = lambda c, *s: F.coalesce(*[F.when(c.endswith(x), True) for x in s], F.lit(False))
    kinds = {
        "ruby": ("ruby", "ruby"), "bash": ("bash", "bash"), "gemfile": ("ruby", "ruby"), "appraisals": ("ruby", "ruby"), "tool_versions": ("text", "tool_versions"),
        "yaml": ("yaml", "yaml"), "gemspec": ("ruby", "ruby"), "markdown": ("markdown", "markdown"), "dotenv": ("dotenv", "dotenv"), "jsonc": ("json", "jsonc"),
        "json": ("json", "json"), "toml": ("toml", "toml"), "rbs": ("rbs", "rbs"), "text": ("text", "text"),
    }
    rules = [
        (plain == ".git-hooks/commit-msg", "ruby"), (plain == ".git-hooks/prepare-commit-msg", "bash"),
        (base.isin("Gemfile", "Appraisal.root.gemfile"), "gemfile"), (base == "Appraisals", "appraisals"), (base.isin("Rakefile", ".simplecov"), "ruby"),
        (base == ".envrc", "bash"), (base == ".tool-versions", "tool_versions"), (base == "CITATION.cff", "yaml"),
        (ends(low_base, ".gemspec"), "gemspec"), (ends(low_base, ".gemfile"), "gemfile"), (ends(low_base, ".rb", ".rake"), "ruby"),
        (ends(low, ".yml", ".yaml"), "yaml"), (ends(low, ".md", ".markdown"), "markdown"), (ends(low, ".sh", ".bash"), "bash"),
        ((low_base == ".env") | low_base.startswith(".env."), "dotenv"), (ends(low, ".jsonc"), "jsonc"), (ends(low, ".json"), "json"), (ends(low, ".toml"), "toml"), (ends(low, ".rbs"), "rbs"),
    ]
    kind = F.when(path.isNull(), F.lit(None))
    for condition, name in rules:
        kind = kind.when(condition, name)
    kind = kind.otherwise("text")
    pick = lambda i: F.element_at(F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v[i]))]), kind)
    file_type = F.when(kind == "jsonc", "json").otherwise(kind)
    return F.struct(path.alias("destination_path"), file_type.alias("file_type"), pick(0).alias("family"), pick(1).alias("dialect"))


def destination_path(path: Column, project_name: str | None = None, omitted: tuple[str, ...] = ()) -> Column:
    """Where a logical path goes; null where it is one of those left out."""
    name = (project_name or "").strip()
    return (
        F.when(path.isin(*omitted) if omitted else F.lit(False), F.lit(None))
        .when(path == ".env.local", ".env.local.example")
        .when((path == "gem.gemspec") & F.lit(bool(name)), f"{name}.gemspec")
        .otherwise(path)
    )


def _key(token: Column, before: int, behind: int) -> Column:
    return F.substring(token, F.lit(before + 1), F.length(token) - before - behind)


def token_keys(content: Column, config: Mapping[str, object] | None = None) -> Column:
    """The distinct tokens of a text in the order of their first places, without what stands around them."""
    pattern, before, behind = token_pattern(config)
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), 0), lambda t: _key(t, before, behind)))


def resolve_tokens(content: Column, replacements: dict[str, str], config: Mapping[str, object] | None = None) -> Column:
    """Each token with a replacement replaced, in one pass; others stay."""
    if not replacements:
        return content
    pattern, before, behind = token_pattern(config)
    table = F.create_map(*[F.lit(x) for kv in replacements.items() for x in kv])
    texts = F.split(content, pattern, -1)
    found = F.regexp_extract_all(content, F.lit(pattern), 0)
    shown = F.transform(found, lambda t: F.coalesce(F.try_element_at(table, _key(t, before, behind)), t))
    return F.aggregate(F.zip_with(texts, shown, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), F.lit(""), lambda acc, x: F.concat(acc, x))
