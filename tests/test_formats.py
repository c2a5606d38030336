"""Parsers and mergers on texts written by hand, and their properties."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae import formats
from tesserae.formats import code, json_family, markdown, ruby, toml_family, trees, yaml_family


def category(result):
    return None if result["ok"] else result["diagnostics"][0]["category"]


def test_json_parse():
    a = formats.parse('{"b":[1,{"c":null}],"a":"é","b2":{}}', "json", "json")
    assert a["root_kind"] == "object" and a["normalized_source"] == '{"b":[1,{"c":null}],"a":"é","b2":{}}'
    assert [(o["path"], o["owner_kind"], o.get("match_key")) for o in a["owners"]] == [("/a", "member", "a"), ("/b", "member", "b"), ("/b/0", "element", None), ("/b/1", "element", None), ("/b/1/c", "member", "c"), ("/b2", "member", "b2")]
    assert formats.parse('{"a":1,"a":2}', "json", "json")["normalized_source"] == '{"a":2}'
    for bad in ('{"a":1,}', "[1,\n]", "{", "", "NaN", "[Infinity]", "// c\n1"):
        assert category(formats.parse(bad, "json", "json")) == "parse_error", bad
    assert formats.parse('[",]", "// no", "\\",]"] // yes', "json", "jsonc")["normalized_source"] == '[",]","// no","\\",]"]'
    assert formats.parse("/* x\n*/ 1", "json", "jsonc")["root_kind"] == "scalar"
    assert category(formats.parse("{}", "json", "jsonc", "language-pack")) == "unsupported_feature"
    assert trees.dump([1e16, 1e15, 1.5, 1e-5, 0.0001, 10**20]) == "[1.0e+16,1000000000000000.0,1.5,1.0e-05,0.0001,100000000000000000000]"


def test_json_merge():
    m = formats.merge('{"a":{"x":1,"y":[1,2]},"n":1}', '{"a":{"y":[3]},"n":null,"z":{}}', "json", "json")
    assert m["output"] == '{"a":{"x":1,"y":[3]},"n":null,"z":{}}' and [p["name"] for p in m["policies"]] == ["destination_wins_array"]
    m = formats.merge('{"a":1}', '{"b":[1,],}', "json", "json")
    assert m["output"] == '{"a":1,"b":[1]}' and m["diagnostics"][0]["category"] == "fallback_applied" and len(m["policies"]) == 2
    assert category(formats.merge("{", "{}", "json", "json")) == "parse_error" and category(formats.merge("{}", "{", "json", "json")) == "destination_parse_error"
    assert formats.merge('{"a":1}', "[1]", "json", "json")["output"] == "[1]" and formats.merge(None, "{}", "json", "json") is None


values = st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(values, values)
def test_json_merge_properties(t, d):
    a, b = json.dumps(t), json.dumps(d)
    out = json.loads(formats.merge(a, b, "json", "json")["output"])
    again = formats.merge(a, json.dumps(out), "json", "json")["output"]
    assert json.loads(again) == out  # converges
    assert json.loads(formats.merge(b, b, "json", "json")["output"]) == d
    if not (isinstance(t, dict) and isinstance(d, dict)):
        assert out == d


scalars = st.booleans() | st.integers(-999, 999) | st.floats(-99, 99).map(lambda x: round(x, 2)) | st.text("ab \"#=[]\\:é", max_size=5)
tables = st.recursive(st.dictionaries(st.text("abc", min_size=1, max_size=2), scalars | st.lists(scalars, max_size=3), max_size=3), lambda x: st.dictionaries(st.text("abc", min_size=1, max_size=2), x | scalars, max_size=3), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(tables, tables)
def test_toml_round_trip_and_merge(t, d):
    assert toml_family.load(toml_family.render(t)) == t
    out = formats.merge(toml_family.render(t), toml_family.render(d), "toml", "toml")
    assert out["ok"] and toml_family.load(out["output"]) == trees.overlay(t, d)


def test_toml_cases():
    assert formats.parse('a."b" = 1', "toml", "toml")["diagnostics"][0]["message"].startswith("Unsupported TOML key path")
    for bad in ("a = 'x'", "a = 1979-05-27", "[a\n", "a = [[1]]", 'a = "x', "a = 1\n[a]\n", "[a.b]\nc=1\n[a]\nb = 2", "a", "a = 1 = 2", "= 1", "a = [1"):
        assert category(formats.parse(bad, "toml", "toml")) == "parse_error", bad
    assert toml_family.load('a.b = 1 # c\r\na.c = "# \\" =" \r[x.y]\nz = []') == {"a": {"b": 1, "c": '# " ='}, "x": {"y": {"z": []}}}
    assert [o["path"] for o in formats.parse("[t]\nk = [1, 2]\n", "toml", "toml")["owners"]] == ["/t", "/t/k", "/t/k/0", "/t/k/1"]
    assert category(formats.parse("", "toml", "toml5")) == "unsupported_feature" and category(formats.merge("", "a", "toml", "toml")) == "destination_parse_error"
    assert all(formats.parse("a = 1", "toml", "toml", b)["ok"] for b in formats.BACKENDS["toml"]) and category(formats.parse("", "toml", "toml", "psych")) == "unsupported_feature"


def test_yaml_cases():
    load = yaml_family.load
    assert load('---\na: 1 # c\nb:\n- x\n- "y: z"\nc:\n  d: [1, \'it\'\'s\', two]\n  e: http://x/#f\nf: "#"\n') == {"a": 1, "b": ["x", "y: z"], "c": {"d": [1, "it's", "two"], "e": "http://x/#f"}, "f": "#"}
    assert load("a: yes\nb: 007\nc: 1.5\nd: '1'\ne: off\nf: 1_000\n") == {"a": True, "b": 7, "c": 1.5, "d": "1", "e": False, "f": 1000}
    for source, want in (("", "parse_error"), ("- a", "parse_error"), ("just text", "parse_error"), ("a: *x", "parse_error"), ("a: |\n  b", None), ("a: b: c", "parse_error"), ("a:\n    b: 1\n  c: 2", "parse_error"), ("a:", "unsupported_feature"), ("a: ~", "unsupported_feature"), ("a:\n  - [1]", "unsupported_feature"), ("a:\n  - b: 1", "unsupported_feature")):
        assert category(formats.parse(source, "yaml", "yaml")) == want, source
    m = formats.merge("a:\n  x: 1\n  l: [1]\n", 'a:\n  l:\n    - "2"\nb: "o k"\n', "yaml", "yaml")
    assert m["output"] == 'a:\n  l:\n    - 2\n  x: 1\nb: "o k"\n'
    assert formats.merge("a: 1\n", 'a: "007"\n', "yaml", "yaml")["output"] == "a: 7\n"  # strings of word characters lose their quotes
    assert [(o["path"], o["owner_kind"]) for o in formats.parse("m:\n  k: 1\ns: [a]\n", "yaml", "yaml")["owners"]] == [("/m", "mapping"), ("/m/k", "key_value"), ("/s", "key_value"), ("/s/0", "sequence_item")]


def test_markdown():
    source = "pre\r\n# One `x` ##\ntext\n####### seven\n```json\n# no heading\n```\n~~~~\nnever closed\n~~~\n## *Two*"
    a = formats.parse(source, "markdown", "markdown")
    assert [(o["path"], o["match_key"]) for o in a["owners"]] == [("/heading/0", "h1:one-x"), ("/code_fence/0", "fence:json"), ("/code_fence/1", "fence:plain")]
    assert [s["address"] for s in a["surfaces"]] == ["document[0] > fenced_code_block[/code_fence/0]"]
    assert formats.merge("# A\na\n# B\nb\n", "lost\n# C\nc\n", "markdown", "markdown")["output"] == "# C\nc\n\n# B\nb\n"
    assert formats.merge("", "", "markdown", "markdown")["output"] == "\n" and formats.merge("# A", "plain", "markdown", "markdown")["output"] == "# A\n"
    put = markdown.splice("# A\n```go\nold\nlines\n```\n\n~~~ts\n~~~\n", {"/code_fence/0": "new\n", "/code_fence/1": ""})
    assert put["output"] == "# A\n```go\nnew\n```\n\n~~~ts\n~~~\n" and category(markdown.splice("x", {"/code_fence/0": ""})) == "configuration_error"
    assert markdown.slugify(" [Hi] there_! ") == "hi-there" and markdown.slugify("***") == "section" and markdown.fence_family("YML") == ("yaml", "yaml") and markdown.fence_family("jsonc") == ("json", "jsonc")


def test_ruby():
    source = "# frozen_string_literal: true\nrequire 'a'\nrequire_relative \"b\"\n\n# Says hi.\n# @example [JSON-Lines]\n#   {}\n# @return x\nclass A::B < C\n  def self.x?\n  end\nend\n\n# :nocov:\ndef y!\nend\n"
    a = formats.parse(source, "ruby", "ruby")
    assert [o["path"] for o in a["owners"]] == ["/declarations/A::B", "/declarations/x?", "/declarations/y!", "/requires/0", "/requires/1"]
    assert [(s["surface_kind"], s["effective_language"], s["start_line"], s["end_line"]) for s in a["surfaces"]] == [("ruby_doc_comment", "yard", 5, 8), ("yard_example_block", "json_lines", 7, 7)]
    assert [p for p, _ in ruby.declarations(source)] == ["/declarations/A::B", "/declarations/y!"]
    assert ruby.declarations("def a\n  if x\n  end\nend\ndef b\nend\n")[0][1] == "def a\n  if x\n  end"  # other openings aren't counted
    many = "".join(f"require 'r{k}'\n" for k in range(11))
    assert [o["path"] for o in formats.parse(many, "ruby", "ruby")["owners"]][:3] == ["/requires/0", "/requires/1", "/requires/10"]
    m = formats.merge("require 'x'\n" + source, "require 'z'\nmodule M\nend\ndef y!\n 1\nend\n", "ruby", "ruby")
    assert m["output"].startswith("require 'z'\n\nmodule M\nend\n\ndef y!\n 1\nend\n\n# Says hi.") and "require 'x'" not in m["output"]
    put = ruby.splice(source, {"document[0] > ruby_doc_comment[A::B] > yard_example[1]": "one\ntwo\n"})
    assert "# @example [JSON-Lines]\n# one\n# two\n# @return x" in put["output"] and category(ruby.splice(source, {"no": ""})) == "configuration_error"


@pytest.mark.parametrize("kind", ["typescript", "rust", "go"])
def test_code(kind):
    imports = {"typescript": 'import {a} from "x";', "rust": "use x::{a, b};", "go": 'import "x"'}[kind]
    one = {"typescript": "export class One {\n  m() { return \"}\"; }\n}", "rust": "pub struct One { a: u8 } // }", "go": "func One() {\n\t/* { */\n}"}[kind]
    two = {"typescript": "const two = `}`;", "rust": "fn two<'a>(x: &'a str) -> char { '}' }", "go": "type two struct{}"}[kind]
    a = formats.parse(f"{imports}\n{two}\n{one}\n", kind, kind)
    assert [(o["path"], o["owner_kind"]) for o in a["owners"]] == [("/imports/0", "import"), ("/declarations/One", "declaration"), ("/declarations/two", "declaration")]
    merged = formats.merge(f"{imports}\n{two}\n", f"{one}\n", kind, kind)
    assert merged["ok"] and imports not in merged["output"] and merged["output"].rstrip().endswith(two)
    assert category(formats.parse("f(", kind, kind)) == "parse_error" and category(formats.merge("", "}", kind, kind)) == "destination_parse_error" and category(formats.parse("", kind, "cobol")) == "unsupported_feature"
    assert formats.merge("", "", kind, kind)["output"] == "\n"


def test_go_imports_are_deduplicated():
    imports, _ = code.analyse("go", 'import "os"\nimport (\n\tx "os"\n\t"io"\n)\n')
    assert [(i["match_key"], i["text"]) for i in imports] == [("os", 'import "os"\n'), ("io", '"io"\n')]  # the longest text of a path


def test_strip_commas_and_comments():
    assert json_family.strip_trailing_commas('[1,[2,],"a,]",]') == '[1,[2],"a,]"]'
    assert json_family.strip_comments('"/*" /* "x */ 1 // y\n2') == '"/*"  1 \n2'
    assert category(formats.parse("x", "cobol", "cobol")) == "unsupported_feature"


def test_yaml_texts_of_several_lines():
    from tesserae.formats import yaml_family

    yaml = pytest.importorskip("yaml")
    for text in (
        "a: |\n  one\n  two\nb: 1\n", "a: |-\n  one\n\n   two\n\nb: 1\n", "a: |+\n  one\n\n\nb: 1\n", "a: >\n  one\n  two\n\n  three\n    four\n  five\nb: x\n", "a: >-\n  one # no comment\n  two: three\n",
        "a:\n  b: |\n    - x\n    y\n  c: 2\n", "a: one\n  two\n  three\nb: 1\n", "a: 'one\n  two'\nb: 1\n", 'a: "one\n  two"\n', "a:\n  - |\n    x\n    y\n  - z\n", "a: |\n\n  x\n", "a: >\n  x\n\n\n  y\n", "a: |2\n   x\n  y\n",
    ):
        assert yaml_family.load(text) == yaml.safe_load(text), text
    for bad in ("a: one\n  b: two\n", 'a: "one"\n  two\n', "a: [1]\n  x\n"):
        with pytest.raises(ValueError):
            yaml_family.load(bad)
    assert yaml_family.parse("a: |\n  x\n  y\n", "yaml")["normalized_source"] == 'a: "x\\ny\\n"\n'


def test_typescript_regular_expressions():
    from tesserae.formats import code

    source = "const r = /[(]/g;\nconst q = a / b / (c);\nfunction f() { return /}[/\"]/.test(x) }\nlet z = s.replace(/'/g, \"\") // {\n"
    assert [d["match_key"] for d in code.analyse("typescript", source)[1]] == ["f", "q", "r", "z"]


def test_toml_merge_reads_each_text_once(monkeypatch):
    """A text is read once, and neither listed nor shown, unless a float may be shown in a way that isn't read."""
    read, plain = [], toml_family.load
    monkeypatch.setattr(toml_family, "load", lambda source: read.append(source) or plain(source))
    monkeypatch.setattr(toml_family, "parse", lambda *_: pytest.fail("the whole analysis is of no use to a merge"))
    t, d = '[a] # x\nk = 1\nb.c = "x # y"\nl = ["q", 2]\n', "a.k = -2\n"
    assert toml_family.merge(t, d, "toml")["output"] == '[a]\nk = -2\nl = ["q", 2]\n\n[a.b]\nc = "x # y"\n'
    assert read == [t, d]
    large = "9" * 25 + ".5"
    assert category(toml_family.merge(f"a = {large}", "", "toml")) == "destination_parse_error" and len(read) == 5
