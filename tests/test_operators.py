"""Operators over DataFrames, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tesserae.functions import structured
from tesserae.functions import template as TF
from tesserae.functions import text as X
from tesserae.operators import conformance, envelopes, match, nested, relational, review, session, template
from tesserae.sources import trees


def test_text_functions(spark):
    df = spark.createDataFrame([(" a\r\n\r\n b  c \r d \n \n\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.normalize_text(F.col("t"))).collect()] == ["a\n\nb c d", "", None]
    spans = df.limit(1).select(X.block_spans(X.blocks(F.col("t")))).first()[0]
    assert [(s["index"], s.normalized, s.start, s.end) for s in spans] == [(0, "a", 0, 1), (1, "b c d", 3, 8)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def refined(t, d):
    """(phase, template, destination) by plain loops."""
    used, out = set(), []
    for j, x in enumerate(d):
        i = next((i for i, y in enumerate(t) if i not in used and x == y), None)
        if i is not None:
            used.add(i)
            out.append(("exact", i, j))
    done = {j for _, _, j in out}
    at = lambda k, n: k / (n - 1) if n > 1 else 0.5
    for j, x in enumerate(d):
        if j in done:
            continue
        best, chosen = 0.0, None
        for i, y in enumerate(t):
            if i in used:
                continue
            n = max(len(x), len(y))
            score = 0.7 * (1 - levenshtein(x, y) / n) + 0.15 * min(len(x), len(y)) / n + 0.15 * (1 - abs(at(i, len(t)) - at(j, len(d))))
            if score >= 0.7 and score > best + 1e-12:
                best, chosen = score, i
        if chosen is not None:
            used.add(chosen)
            out.append(("refined", chosen, j))
    return out


def test_refined_match_and_merge(spark):
    rng = random.Random(5)
    pairs = []
    for p in range(30):
        t = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9))).strip() or "a" for _ in range(rng.randrange(0, 6))]
        d = [x if rng.random() < 0.3 else x[: rng.randrange(len(x))] + rng.choice("abc") + x[rng.randrange(len(x)) :] for x in rng.sample(t, len(t))] + ["zzz"] * rng.randrange(2)
        pairs.append((p, t, [" ".join(x.split()) for x in d]))
    rows = lambda k: spark.createDataFrame([(p[0], i, b, len(p[k])) for p in pairs for i, b in enumerate(p[k])], "pair_id long, index int, normalized string, total long")
    got = match.match_text_blocks(rows(1), rows(2)).filter("phase is not null").collect()
    assert sorted((r.pair_id, r.phase, r.template_index, r.destination_index) for r in got) == sorted((p, *m) for p, t, d in pairs for m in refined(t, d))
    assert {r.phase for r in got} == {"exact", "refined"}
    merged = {r.pair_id: r.output for r in match.merge_text(rows(1), rows(2)).collect()}
    for p, t, d in pairs:
        used = {i for _, i, _ in refined(t, d)}
        if t or d:
            assert merged[p] == "\n\n".join(d + [x for i, x in enumerate(t) if i not in used])


def test_refined_match_has_one_shuffle_and_no_pairs(spark):
    """Blocks of a pair meet in one row: no join of every block with every other, no distance cell by cell."""
    blocks = spark.createDataFrame([(1, 0, 0, "a b", 1), (1, 1, 0, "a c", 1)], "pair_id long, side int, index int, normalized string, total int")
    for df in (match.match_tagged(blocks), match.merge_tagged(blocks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "levenshtein" not in plan and "Union" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("together", [30, 4096])
def test_refined_ways_match_brute_force(monkeypatch, together):
    """Long blocks, alike at their ends or not at all, compared some at once."""
    from tesserae.functions import refined as ways_of

    monkeypatch.setattr(ways_of, "TOGETHER", together)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5)))
    taken = 0
    for _ in range(25):
        t = [" ".join(word() for _ in range(rng.randrange(1, 25))) for _ in range(rng.randrange(1, 7))]
        d = []
        for x in rng.sample(t, len(t)):
            w = x.split()
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = word()
            d.append(rng.choice([" ".join(w), x.partition(" ")[2] or "b", "q" + x[1:-1] + "q", x[len(x) // 3 :].strip() or "c"]))
        t, d = ([b for b in one if b not in other] for one, other in ((t, d), (d, t)))
        side = lambda one: [{"index": i, "normalized": b, "total": len(one)} for i, b in enumerate(one)]
        got = [("refined", a, b) for a, b, _ in ways_of.ways(side(t), side(d))]
        assert got == refined(t, d)
        taken += len(got)
    assert taken > 30


def test_owner_match_keeps_repeats(spark):
    t = spark.createDataFrame([(1, 0, "/a"), (1, 1, "/a"), (1, 2, "/b"), (2, 0, "/a")], "pair_id long, ord int, path string")
    d = spark.createDataFrame([(1, 0, "/a"), (1, 1, "/c")], "pair_id long, ord int, path string")
    got = sorted((r.pair_id, r.status, r.path, r.ord) for r in match.match_owners(t, d).collect())
    assert got == [(1, "matched", "/a", 0), (1, "matched", "/a", 1), (1, "unmatched_destination", "/c", 1), (1, "unmatched_template", "/b", 2), (2, "unmatched_template", "/a", 0)]


def test_relational_merge_equals_the_recursive_one(spark):
    import json

    rng = random.Random(9)

    def value(depth):
        return {rng.choice("abc"): value(depth - 1) for _ in range(rng.randrange(3))} if depth and rng.random() < 0.7 else rng.choice([1, None, "x", [1, {"a": 2}], {}])

    df = spark.createDataFrame([(i, json.dumps(value(3)), json.dumps(value(3))) for i in range(120)], "pair_id long, t string, d string")
    nodes = lambda c: relational.json_nodes(df.select("pair_id", F.col(c).alias("source")))
    by_joins = {r.pair_id: r.output for r in relational.render(relational.merge_nodes(nodes("t"), nodes("d"))).collect()}
    by_udf = {r.pair_id: r.o for r in df.select("pair_id", structured.merge(F.col("t"), F.col("d"), "json")["output"].alias("o")).collect()}
    assert {k: json.loads(v) for k, v in by_joins.items()} == {k: json.loads(v) for k, v in by_udf.items()}


def test_classification(spark):
    want = {
        ".git-hooks/commit-msg": "ruby", "./.git-hooks/prepare-commit-msg": "bash", "x/Gemfile": "gemfile", "Appraisals": "appraisals", "a/.simplecov": "ruby", ".envrc": "bash", ".tool-versions": "tool_versions",
        "CITATION.cff": "yaml", "A.GEMSPEC": "gemspec", "x.gemfile": "gemfile", "lib/a.rake": "ruby", "A.YML": "yaml", "README.md": "markdown", "a.bash": "bash", ".env.local": "dotenv", "a.jsonc": "json", "a.json": "json", "a.toml": "toml", "s.rbs": "rbs", "gemfile": "text", "": "text",
    }
    df = spark.createDataFrame([(p,) for p in [*want, None]], "p string")
    got = {r.p: r.t for r in df.select("p", TF.classify(F.col("p"))["file_type"].alias("t")).collect()}
    assert got == want | {None: None}
    paths = spark.createDataFrame([("a.example",), ("a.no-osc.example",), ("a.example.example",), ("gem.gemspec",), (".tool.yml",), (".env.local",)], "p string")
    assert [r[0] for r in paths.select(TF.destination_path(TF.logical_path(F.col("p")), "mine", (".tool.yml",))).collect()] == ["a", "a", "a.example", "mine.gemspec", None, ".env.local.example"]


def test_tokens(spark):
    df = spark.createDataFrame([("{A|B} {A|B:C_1}{A|B} {no} {A:B} {X|Y}",), (None,), ("",)], "c string")
    rows = df.select(TF.token_keys(F.col("c")), TF.resolve_tokens(F.col("c"), {"A|B": "{X|Y}", "A|B:C_1": ""})).collect()
    assert [tuple(r) for r in rows] == [(["A|B", "A|B:C_1", "X|Y"], "{X|Y} {X|Y} {no} {A:B} {X|Y}"), ([], None), ([], "")]


FILES = [("a.toml", "x = 1\n"), ("b.md.example", "# {P|N}\n"), ("c.rb", "def c\nend\n"), ("d.json", "{}"), ("e.txt", "{Q|R}"), (".tool.yml", "k"), ("same.txt", "same"), ("keep.txt", "t")]


def test_session_over_directories(spark, tmp_path):
    source, target = tmp_path / "t", tmp_path / "d"
    for p, c in FILES:
        (source / p).parent.mkdir(parents=True, exist_ok=True)
        (source / p).write_text(c)
    (source / "sub").mkdir()
    (source / "sub/new ä.txt").write_text("deep")
    target.mkdir()
    for p, c in (("a.toml", "y = 2\n"), ("d.json", "{}"), ("same.txt", "same"), ("keep.txt", "mine")):
        (target / p).write_text(c)
    ask = lambda mode, **k: session.run(spark, session.Request(mode, str(source), str(target), overrides=(("./same.txt", "raw_copy"), ("keep.txt", "keep_destination"), ("keep.txt", "merge")), omitted=(".tool.yml",), **k))
    planned = ask("plan")
    assert planned.written == 0 and planned.status.first().planned_write_count == 5
    reasons = [(r.path, r.reason) for r in session.entry_diagnostics(planned.plan).collect()]
    assert reasons == [("b.md", "unresolved_tokens"), ("d.json", "missing_family_adapter"), ("e.txt", "unresolved_tokens"), ("sub/new ä.txt", "missing_family_adapter")]
    done = ask("apply", replacements={"P|N": "Name", "Q|R": "v"})
    status = {r.logical_destination_path: r.status for r in done.applied.collect()}
    assert status == {"a.toml": "updated", "b.md": "created", "c.rb": "created", "d.json": "blocked", "e.txt": "created", ".tool.yml": "omitted", "same.txt": "kept", "keep.txt": "kept", "sub/new ä.txt": "created"}
    assert done.written == 5 and (target / "a.toml").read_text() == "x = 1\ny = 2\n" and (target / "b.md").read_text() == "# Name\n" and (target / "sub/new ä.txt").read_text() == "deep" and (target / "keep.txt").read_text() == "mine"
    row = done.status.first()
    assert not row.ready and row.missing_families == ["json", "text"] and row.blocked_paths == ["d.json"] and row.written_count == 5
    again = ask("reapply", replacements={"P|N": "Name", "Q|R": "v"})
    assert {r.logical_destination_path: r.status for r in again.applied.collect()}["a.toml"] == "kept" and again.written <= 3
    assert session.Request("odd").normalized_mode() == "plan" and len(session.Request().diagnostics()) == 2
    with pytest.raises(ValueError):
        template.session_status("odd", planned.plan)


def test_trees(spark, tmp_path):
    assert trees.read_tree(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "f").write_text("x")
    with pytest.raises(NotADirectoryError):
        trees.read_tree(spark, str(tmp_path / "f"))
    df = spark.createDataFrame([("a/b.txt", "é"), ("c", ""), (".hidden", "h"), ("n", None)], "path string, content string")
    assert trees.write_tree(df, str(tmp_path / "o")) == 3
    assert {(r.path, r.content) for r in trees.read_tree(spark, str(tmp_path / "o")).collect()} == {("a/b.txt", "é"), ("c", ""), (".hidden", "h")}
    with pytest.raises(Exception, match="leads out"):
        trees.write_tree(spark.createDataFrame([("../x", "y")], "path string, content string"), str(tmp_path / "o"))


def test_plan_reports(spark):
    t = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(FILES)], "ord int, path string, content string")
    d = spark.createDataFrame([("d.json", "{}")], "path string, content string")
    plan = template.plan_execution(t, d, default_strategy="accept_template", omitted=(".tool.yml",))
    report = template.plan_report(plan)
    assert template.summary(report, "create", "update", "keep", "blocked", "omitted").first().asDict() == {"create": 4, "update": 1, "keep": 0, "blocked": 2, "omitted": 1}
    applied = template.apply(plan)
    assert template.summary(template.apply_report(applied), "created", "kept", "blocked", "omitted").first().asDict() == {"created": 4, "kept": 1, "blocked": 2, "omitted": 1, "written": 4}
    assert {r.path for r in template.convergence(plan).collect()} == {"a.toml", "b.md", "c.rb", "e.txt", "same.txt", "keep.txt"}
    assert template.plan_execution(t.limit(0), d).count() == 0


def test_conformance(spark):
    suites = spark.createDataFrame([(0, "portable", "json", None, ["merge", "parse", "gone"]), (1, "portable", "json", None, ["late"]), (2, "native", "toml", "v", [])], "ord int, kind string, grammar string, variant string, roles array<string>")
    families = spark.createDataFrame([(0, "json", "merge", ["a"], None), (1, "json", "merge", ["b"], None), (2, "json", "parse", ["c"], ("fast", None, None))], f"ord int, family string, role string, path array<string>, requirements {conformance.REQUIREMENTS}")
    assert [tuple(r) for r in conformance.suite_selectors(suites).collect()] == [("native", "toml", "v"), ("portable", "json", None)]
    first = conformance.suite_definition(suites, conformance.suite_selectors(suites))
    assert sorted(r.ord for r in first.collect()) == [0, 2]
    planned = {r.role: (r.path, r.missing) for r in conformance.plan_suite(first, families).collect()}
    assert planned == {"merge": (["a"], False), "parse": (["c"], False), "gone": (None, True)}
    contexts = spark.createDataFrame([("json", "mine")], "family string, context string")
    profiles = spark.createDataFrame([("json", "d"), ("toml", "t")], "family string, profile string")
    wanted = spark.createDataFrame([("json",), ("toml",), ("yaml",)], "family string")
    got = {r.family: (r.context, r.assumed, [x.category for x in r.diagnostics]) for r in conformance.resolve_family_contexts(wanted, contexts, profiles).collect()}
    assert got == {"json": ("mine", False, []), "toml": ("t", True, ["assumed_default"]), "yaml": (None, False, ["configuration_error"])}
    strict = {r.family: (r.context, len(r.diagnostics)) for r in conformance.resolve_family_contexts(wanted, contexts, profiles, True).collect()}
    assert strict == {"json": ("mine", 0), "toml": (None, 1), "yaml": (None, 1)}
    results = spark.createDataFrame([("passed",), ("odd",), (None,)], "outcome string")
    assert conformance.summarize(results).first().asDict() == {"total": 3, "passed": 1, "failed": 0, "skipped": 0}
    assert conformance.sum_summaries(conformance.summarize(results).limit(0)).first().total == 0


def test_review(spark):
    cases = spark.createDataFrame([(2, "c2", "d2", "g", "p2", "x2", "s"), (0, "c0", "d0", "g", "p0", "x0", "s"), (1, "c1", "d1", "h", "p1", "x1", "s")], "ord int, case_id string, delegated_case_id string, delegated_apply_group string, parent_operation_id string, child_operation_id string, delegated_runtime_surface_path string")
    groups = review.group_cases(cases)
    got = {r.delegated_apply_group: (r.parent_operation_id, r.case_ids, r.delegated_case_ids) for r in groups.collect()}
    assert got == {"g": ("p0", ["c0", "c2"], ["d0", "d2"]), "h": ("p1", ["c1"], ["d1"])}
    resolved = spark.createDataFrame([("c2",), ("c1",), ("c1",)], "case_id string")
    assert {r.delegated_apply_group: (r.resolved_case_ids, r.pending_case_ids) for r in review.progress(groups, resolved).collect()} == {"g": (["c2"], ["c0"]), "h": (["c1"], [])}
    assert [r.delegated_apply_group for r in review.ready_for_apply(groups, resolved).collect()] == ["h"]
    decisions = spark.createDataFrame([(5, "projected_child_group:g", review.APPLY), (4, "projected_child_group:g", review.APPLY), (1, "projected_child_group:h", "wait"), (2, "stale", review.APPLY)], "ord int, request_id string, action string")
    assert [r.delegated_apply_group for r in review.accepted_groups(groups, decisions).collect()] == ["g"]
    assert [r.id for r in review.review_requests(groups, decisions, "ruby").collect()] == ["projected_child_group:h"]
    assert [(r.request_id, r.diagnostic.category) for r in review.rejected_decisions(groups, decisions).collect()] == [("stale", "replay_rejected")]
    assert [r.decision.ord for r in review.apply_plan(groups, decisions, "ruby").collect()] == [4]
    families = spark.createDataFrame([("json", True), ("toml", False), ("yaml", True), ("go", True)], "family string, has_profile boolean")
    told = spark.createDataFrame([(0, "family_context:json", "other", None), (1, "family_context:json", "accept_default_context", None), (0, "family_context:toml", "accept_default_context", None), (1, "family_context:toml", "provide_explicit_context", None), (0, "family_context:yaml", "provide_explicit_context", "json"), (1, "family_context:yaml", "accept_default_context", None), (0, "family_context:go", "provide_explicit_context", "go")], "ord int, request_id string, action string, context_family string")
    assert {r.family: r.outcome for r in review.family_decisions(families, told).collect()} == {"json": "accepted_default", "toml": "missing_required_payload", "yaml": "family_mismatch", "go": "explicit"}
    context = "struct<surface:string,families:array<string>,require_explicit_contexts:boolean>"
    pairs = spark.createDataFrame([(("m", ["a", "b"], True), ("m", ["a", "b"], True)), (("m", ["a", "b"], True), ("m", ["b", "a"], True)), (("m", [], False), None)], f"x {context}, y {context}")
    assert [r[0] for r in pairs.select(review.replay_compatible(F.col("x"), F.col("y"))).collect()] == [True, False, False]


@pytest.mark.parametrize("kind", sorted(envelopes.FIELDS))
def test_envelopes(spark, kind):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "k long, l array<string>")
    sent = df.select("k", envelopes.export(F.struct("k", "l"), kind).alias("e"))
    got = sent.select(envelopes.read(F.col("e"), kind, "struct<k:bigint,l:array<string>>").alias("r")).orderBy("r.payload.k").collect()
    assert [(r.r.payload.k, r.r.payload.l, r.r.error) for r in got] == [(1, ["a"], None), (2, None, None)]


def test_envelope_errors(spark):
    bad = spark.createDataFrame([('{"kind":"x","version":9}',), ('{"kind":"review_replay_bundle","version":2,"replay_bundle":{"k":1}}',), ('{"kind":"review_replay_bundle","replay_bundle":{"k":1}}',), ("nonsense",), (None,)], "e string")
    got = [r[0] for r in bad.select(envelopes.read(F.col("e"), "review_replay_bundle", "struct<k:int>")).collect()]
    assert [g.error and g.error.category for g in got] == ["kind_mismatch", "unsupported_version", "unsupported_version", "kind_mismatch", None] and all(g.payload is None for g in got)
    assert len(envelopes.FIELDS) >= 61


def test_nested_merges(spark):
    pairs = spark.createDataFrame([(1, "# T\n```json\nold\n```\n", "# D\n"), (2, "# T\n```json\n```\n", "x"), (3, "# only", "# d"), (4, None, "x")], "pair_id long, template string, destination string")
    at = "document[0] > fenced_code_block[/code_fence/0]"
    outputs = spark.createDataFrame([(1, 0, at, "new\n"), (2, 0, at, "a"), (2, 1, "nowhere", "b")], "pair_id long, ord int, surface_address string, output string")
    got = {r.pair_id: r.result for r in nested.merge_with_outputs(pairs, outputs, "markdown").collect()}
    assert got[1].output == "# D\n\n```json\nnew\n```\n" and not got[2].ok and got[2].diagnostics[0].message == "missing delegated child surface nowhere." and got[3].output == "# d\n" and got[4] is None
    plan = spark.createDataFrame([(1, 0, "markdown-fence-0"), (1, 1, "absent")], "pair_id long, ord int, child_operation_id string")
    applied = spark.createDataFrame([(1, "markdown-fence-0", "seen")], "pair_id long, operation_id string, output string")
    got = {r.pair_id: r.result for r in nested.merge_with_review(pairs, plan, applied, "markdown").collect()}
    assert "seen" in got[1].output
    ruby = spark.createDataFrame([(1, "# Doc.\n# @example\n#   x\nclass A\nend\n", "")], "pair_id long, template string, destination string")
    out = spark.createDataFrame([(1, 0, "document[0] > ruby_doc_comment[A] > yard_example[1]", "y")], "pair_id long, ord int, surface_address string, output string")
    assert nested.merge_with_outputs(ruby, out, "ruby").first().result.output == "# Doc.\n# @example\n# y\nclass A\nend\n"


def test_similarity(spark):
    side = lambda *b: spark.createDataFrame([(1, list(b[0])), (2, list(b[1])), (3, [])], "pair_id long, blocks array<string>")
    got = {r.pair_id: (round(r.score, 6), r.matched) for r in match.is_similar(match.similarity(side(["a b", "c"], ["x"]), side(["a c"], ["x"])), 1.0).collect()}
    assert got == {1: (round(1 / 6, 6), False), 2: (1.0, True), 3: (1.0, True)}


def test_edit_records(spark):
    from tesserae.operators import edits

    df = spark.createDataFrame([("insert", "text", "here")], "k string, c string, l string")
    request = edits.record("request", operation_kind="k", content="c", source_label="l")
    sent = df.select(envelopes.export(edits.record("execution_request", request=request, provider_family=F.lit("ruby")), "structured_edit_provider_execution_request").alias("e"))
    import json

    assert json.loads(sent.first().e) == {"kind": "structured_edit_provider_execution_request", "version": 1, "execution_request": {"request": {"operation_kind": "insert", "content": "text", "source_label": "here"}, "provider_family": "ruby"}}
    many = df.select(edits.batch("execution_request", F.array(request)).alias("b")).first().b
    assert many.requests[0].content == "text"
    with pytest.raises(ValueError, match="lacks content"):
        edits.record("request", operation_kind="k", source_label="l")
    with pytest.raises(ValueError, match="has no odd"):
        edits.record("request", operation_kind="k", content="c", source_label="l", odd="k")
    assert len(edits.RECORDS) >= 55


def test_review_of_a_manifest(spark):
    from tesserae.operators import manifest

    profile = ("json", ["json"], [])
    suites = spark.createDataFrame([("portable", "json", None, ["merge"]), ("portable", "toml", None, ["merge", "gone"]), ("portable", "yaml", None, ["merge"])], "kind string, grammar string, variant string, roles array<string>")
    families = spark.createDataFrame([(i, f, "merge", ["p"], None) for i, f in enumerate(("json", "toml", "yaml"))], f"ord int, family string, role string, path array<string>, requirements {conformance.REQUIREMENTS}")
    typed = lambda rows, c: spark.createDataFrame(rows, f"family string, {c} {conformance.FAMILY_PROFILE}")
    contexts, profiles = typed([("json", profile)], "context"), typed([("toml", ("toml", ["toml"], []))], "profile")
    none = spark.createDataFrame([], "ord int, request_id string, action string, context_family string")
    context = lambda families, explicit: spark.createDataFrame([("conformance_manifest", families, explicit)], "surface string, families array<string>, require_explicit_contexts boolean")
    told = lambda s: sorted((r.reason, r.diagnostic.category) for r in s.diagnostics.collect())
    state = manifest.review_manifest(suites, families, contexts, profiles, none, context(["json", "toml", "yaml"], False))
    assert [r.grammar for r in state.runs.collect()] == ["json"] and state.requests.count() == 0
    assert told(state) == [("family_context", "assumed_default"), ("family_context", "configuration_error"), ("missing_roles", "configuration_error")]
    assert [tuple(r) for r in manifest.report(state, lambda row: ("passed", [])).collect()] == [("json", 1, 1, 0, 0)]
    decisions = spark.createDataFrame([(0, "family_context:toml", "accept_default_context", None), (1, "family_context:gone", "accept_default_context", None)], none.schema)
    state = manifest.review_manifest(suites, families, contexts, profiles, decisions, context(["json", "toml", "yaml"], True), True)
    assert [r.request_id for r in state.applied_decisions.collect()] == ["family_context:toml"] and state.requests.count() == 0
    assert ("request_not_found", "replay_rejected") in told(state) and ("missing_roles", "configuration_error") in told(state)
    state = manifest.review_manifest(suites, families, contexts, profiles, decisions, context(["toml", "json", "yaml"], True), True)
    assert ("context_mismatch", "replay_rejected") in told(state) and [r.id for r in state.requests.collect()] == ["family_context:toml"]
    state = manifest.review_manifest(suites, families, contexts, profiles, decisions, None, True)
    assert ("missing_context", "replay_rejected") in told(state)


def test_distance_by_bits():
    import random

    from tesserae.functions import distance

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé好") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randrange(0, len(a) + 1)] + b[:2] + a[rng.randrange(0, len(a) + 1) :]
        want = plain(a, b)
        for most in (0, 2, 5, 30):
            assert distance.bounded(a, b, most) == (want if want <= most else -1)
    for _ in range(200):
        text, *others = ("".join(rng.choice("abé好") for _ in range(rng.randrange(0, 90))) for _ in range(rng.randrange(2, 6)))
        patterns = [(len(o), distance.places(o)) for o in others]
        want = [plain(o, text) for o in others]
        assert distance.beside(patterns, text, [1000] * len(others)) == want
        for most in (0, 5, 40):
            found = distance.beside(patterns, text, [most] * len(others))
            assert found == want or found == [-1] * len(others) and min(want) > most
    long = "word " * 9000
    assert distance.bounded(long, "x" + long[7:], 50) == 7


def test_tokens_of_other_looks(spark):
    from tesserae.functions import template as T

    text = "a {A|B} {A|B:C:D} {A} <<x.y>> <<x.y.z>> <<x>> {A:B} {A|B|C}"
    df = spark.createDataFrame([(text,), (None,)], "c string")
    for config, want in (
        (None, ["A|B", "A|B:C:D"]), ({"min_segments": 1}, ["A|B", "A|B:C:D", "A"]), ({"max_segments": 2}, ["A|B"]), ({"max_segments": 3}, ["A|B"]), ({"min_segments": 4}, ["A|B:C:D"]),
        ({"pre": "<<", "post": ">>", "separators": ["."]}, ["x.y", "x.y.z"]), ({"pre": "<<", "post": ">>", "separators": ["."], "min_segments": 1, "max_segments": 2}, ["x.y", "x"]), ({"segment_pattern": "[A-B]"}, ["A|B"]),
    ):
        assert [r[0] for r in df.select(T.token_keys(F.col("c"), config)).collect()] == [want, []]
    got = df.select(T.resolve_tokens(F.col("c"), {"x.y": "1", "x": "2"}, {"pre": "<<", "post": ">>", "separators": ["."], "min_segments": 1})).first()[0]
    assert got == text.replace("<<x.y>>", "1").replace("<<x>>", "2")
    with pytest.raises(ValueError):
        T.token_pattern({"min_segments": 3, "max_segments": 2})


def test_own_mergers_and_invocations(spark, tmp_path):
    from tesserae.operators import requests

    source, target = tmp_path / "t", tmp_path / "d"
    for root, files in ((source, {"a.md": "# T {X|Y}\n", "b.yml": "k: 1\n", "c.txt": "new"}), (target, {"a.md": "# D\n", "b.yml": "z: 1\n"})):
        root.mkdir()
        for name, content in files.items():
            (root / name).write_text(content)
    roots = {"template_root": str(source), "destination_root": str(target)}
    seen = requests.invoke(spark, {"operation": "inspect", "replacements": {"X|Y": "!"}, **roots})
    assert seen["outcome"] is None and seen["inspection"]["mode"] == "plan" and seen["inspection"]["source_kind"] == "payload"
    status = seen["inspection"]["session"].status.first()
    assert status.missing_families == ["text", "yaml"] and not status.ready and (target / "a.md").read_text() == "# D\n"
    plan = seen["inspection"]["session"].plan
    own = {r.destination_path: (r.status, r.output) for r in template.apply(plan, {"yaml": lambda e: {"ok": True, "output": e["prepared_template_content"] + e["destination_content"]}}).collect()}
    assert own == {"a.md": ("blocked", None), "b.yml": ("updated", "k: 1\nz: 1\n"), "c.txt": ("created", "new")}
    lost = requests.invoke(spark, {"operation": "run", "request": {"request_kind": "options", "options": {"mode": "odd"}}})["outcome"]
    assert [d["reason"] for d in lost.diagnostics] == ["missing_destination_root", "missing_template_root"] and lost.plan is None
    profiles = {"p": {"mode": "apply", "default_strategy": "accept_template", "replacements": {"X|Y": "p"}}}
    none = requests.resolve({"payload": {"profile_name": "q", **roots}}, profiles)["session_request"]
    assert not none["ready"] and [d["reason"] for d in none["diagnostics"]] == ["missing_profile"]
    done = requests.invoke(spark, {"operation": "run", "payload": {"default_profile_name": "p", **roots}}, profiles)["outcome"]
    assert done.written == 3 and (target / "a.md").read_text() == "# T p\n"
    told = requests.entrypoint({"payload": {"profile_name": "p", "context": {"project_name": "n"}, "default_strategy": "merge", **roots}})
    assert told["runner_request"]["overrides"] == {"mode": None, "context": {"project_name": "n"}, **roots} and requests.entrypoint({})["source_kind"] == ""
    for bad in (lambda: requests.invoke(spark, {"operation": "x"}), lambda: session.run(spark, session.Request("odd", str(source), str(target)))):
        with pytest.raises(ValueError, match="unsupported"):
            bad()


def test_tasks_have_bounded_rows(spark, tmp_path):
    """A table in few files is divided by its rows, not by the cores only."""
    from tesserae.sources import spread, table

    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    df = table(spark, str(tmp_path), "t")
    got = spread(df, "id", 50)
    assert got.rdd.getNumPartitions() == 20 and got.count() == 1000 and max(map(len, got.rdd.glom().collect())) < 100
    assert spread(df, "id", 10**6).rdd.getNumPartitions() == max(df.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)


def test_relational_merge_is_divided_by_its_pairs(spark, tmp_path):
    """The shuffle has as many partitions as the pairs ask, and AQE doesn't put them together."""
    from tesserae.plans import registry

    spark.range(400_000).selectExpr("id AS event_id", "7L AS user_id", "'x' AS event_type", "'{\"k\": 1}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    df = registry.QUERIES["json_merge_relational"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(pair_id" in plan and "REPARTITION_BY_NUM" in plan
    few = spark.createDataFrame([(1, 0, ["a"], False, "1"), (1, 1, ["a"], False, "2")], "pair_id long, side int, path array<string>, is_object boolean, value string")
    assert relational.merge_tagged(few, 7).rdd.getNumPartitions() == 7
    assert [r.value for r in relational.merge_tagged(few, 7).collect()] == ["2"]
