"""Near and substring dedup, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserae.llm import arrays, components, simhash, spherical, substring


def groups(n, near):
    """Least member of each one's connected component."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(5, 5), (7, 8), (8, 7)]
    want = groups(300, pairs)
    got = {r.v: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {v: r for v, r in enumerate(want) if r != v}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("shard", [20_000, 60])
def test_simhash_pairs_are_exact(sf, shard):
    prints = simhash.fingerprint_table(sf("documents"))
    points = prints.groupBy("high", "low", "words").agg(F.min("id").alias("rep")).cache()
    rows = points.collect()
    fp = np.array([(r.high, r.low) for r in rows], np.int64).view(np.uint64)
    words, rep = np.array([r.words for r in rows]), np.array([r.rep for r in rows])
    near = (simhash.hamming(fp[:, None], fp[None]) <= simhash.RADIUS) & (4 * np.maximum(words[:, None], words) <= 5 * np.minimum(words[:, None], words))
    a, b = np.nonzero(np.triu(near, 1))
    want = {(min(rep[x], rep[y]), max(rep[x], rep[y])) for x, y in zip(a, b, strict=True)}
    got = [tuple(r) for r in simhash.near(points, forest=False, shard_points=shard, task_queries=100).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    forest = {tuple(r) for r in simhash.near(points, shard_points=shard, task_queries=100).collect()}
    index = {r: k for k, r in enumerate(sorted(rep))}
    both = [groups(len(rep), [(index[u], index[v]) for u, v in e]) for e in (want, forest)]
    assert both[0] == both[1]


def test_simhash_cases(docs, none, rows):
    found = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(docs).collect()}
    assert found[7] == 6 and found[12] == 11 and not {1, 2, 3, 4, 5, 8, 9, 10, 11, None} & found.keys()
    left = simhash.drop_near_duplicates(docs)
    ids = sorted(str(r.doc_id) for r in left.collect())
    assert left.columns == docs.columns
    assert ids == sorted(["1", "2", "None", "None", "3", "4", "5", "6", "8", "8", "9", "10", "11"])
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_texts_of_one_id_are_documents(spark):
    """Whatever the order of rows, another text of an id stays, and goes only as a near copy."""
    from tests.llm.conftest import sentence

    table = [(1, sentence(1, 90)), (1, sentence(2, 90)), (1, sentence(1, 90) + " z"), (2, sentence(2, 90) + " end"), (2, sentence(3, 90)), (2, sentence(3, 90))]
    results = []
    for some in (table, table[::-1]):
        df = spark.createDataFrame(some, "doc_id long, text string").repartition(2)
        results.append(sorted(map(tuple, simhash.drop_near_duplicates(df).collect())))
        assert [tuple(r) for r in simhash.near_duplicates(df).collect()] == [(2, 1)]
    assert results[0] == results[1] and len(results[0]) == 3 and {table[1], table[4]} <= set(results[0]) and {i for i, _ in results[0]} == {1, 2}


def test_groups_match_brute_force(sf):
    """Groups by the definition, over all pairs of documents: bits, lengths and a shared anchor."""
    docs = sf("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and any(c.isalnum() for c in r.text)]
    column = pa.array([t for _, t in rows])
    row, word = simhash._words(column)
    high, low, words = simhash.fingerprints(column)
    fp = np.stack([high, low], axis=1)
    bounds, found = simhash.anchors(row, word, len(rows))
    scopes = [set(found[a:z].tolist()) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    for i in (0, 5, 17):  # the least hashes, told by plain Python
        w = word[row == i]
        with np.errstate(over="ignore"):
            three = [int(arrays.mix(np.array([a * np.uint64(0x51ED270B9F652295) + b * np.uint64(0xA24BAED4963EE407) + c]))[0]) for a, b, c in zip(w, w[1:], w[2:], strict=False)]
        assert scopes[i] == set(sorted(set(three or w.tolist()))[: simhash.ANCHORS])
    near = (simhash.hamming(fp[:, None], fp[None]) <= simhash.RADIUS) & (4 * np.maximum(words[:, None], words) <= 5 * np.minimum(words[:, None], words))
    every = [(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    equal = lambda a, b: high[a] == high[b] and low[a] == low[b] and words[a] == words[b]
    pairs = [(a, b) for a, b in every if scopes[a] & scopes[b] or equal(a, b)]
    assert len(pairs) > 0.98 * len(every)
    root = groups(len(rows), pairs)
    ids = [i for i, _ in rows]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, ids[k]), ids[k])
    got = {r.doc_id: r.kept_doc_id for r in simhash.near_duplicates(docs).collect()}
    assert got == {ids[k]: least[r] for k, r in enumerate(root) if ids[k] != least[r]} and got


def reordered(n):
    """(id, text): pairs of texts of the same words in opposite order, one with a word more, without a run in common."""
    from tests.llm.conftest import sentence

    texts = [sentence(k, 150, 10**6) for k in range(n)]
    return [(2 * k, t) for k, t in enumerate(texts)] + [(2 * k + 1, " ".join(t.split()[::-1]) + " more") for k, t in enumerate(texts)]


def test_near_copies_without_a_common_run(spark):
    """Fingerprints don't depend on the order of words, so texts in another order are near copies."""
    table = reordered(30)
    high, low, words = simhash.fingerprints(pa.array([t for _, t in table]))
    fp = np.stack([high, low], axis=1)
    assert not ((high[:30] == high[30:]) & (low[:30] == low[30:])).all() and (simhash.hamming(fp[:30], fp[30:]) <= simhash.RADIUS).all()
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == {(2 * k + 1, 2 * k) for k in range(30)}


@pytest.mark.parametrize("radius", [24, 5, 30])
def test_pieces_lose_no_pair(radius, monkeypatch):
    """The search by pieces against all pairs, of a set with itself and with another; blocks of any size."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, (150, 128), np.uint8)
    bits = base[rng.integers(0, 150, 1500)] ^ (rng.random((1500, 128)) < rng.uniform(0, 0.2, (1500, 1)))
    bits[700:720] = bits[0]  # equal ones
    fp = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)
    close = simhash.hamming(fp[:, None], fp[None]) <= radius
    monkeypatch.setattr(simhash, "TOGETHER", 5_000)
    for points, queries, itself, want in ((fp, fp, True, np.triu(close, 1)), (fp[:900], fp[900:], False, close[900:, :900])):
        found = [np.concatenate(x) for x in zip(*simhash._by_pieces(points, queries, radius, itself), strict=True)]
        got = set(zip(*(x.tolist() for x in found), strict=True))
        assert len(got) == len(found[0]) and got == set(zip(*(x.tolist() for x in np.nonzero(want)), strict=True)) and len(got) > 20


def test_points_meet_few_others(spark):
    """Of texts without copies no row reaches a search, and near copies meet in their scopes, however many
    documents there are: rows a point don't grow with the table."""
    from tests.llm.conftest import sentence

    rates = []
    for n in (500, 4000):
        table = [(k, sentence(k // 2, 60, 10**6) + (" and so on" if k % 2 else "")) for k in range(n)]
        prints = simhash.fingerprint_table(spark.createDataFrame(table, "doc_id long, text string").repartition(4))
        each = prints.select("id", F.explode("anchors").alias("scope"))
        met = each.join(each.groupBy("scope").count().filter("count > 1"), "scope")
        rates.append(met.count() / n)
        assert met.agg(F.max("count")).first()[0] == 2
        assert simhash.duplicates_of(prints).count() == n // 2
    assert abs(rates[0] - rates[1]) < 0.2 and rates[0] <= simhash.ANCHORS


def test_large_scopes_are_divided(spark):
    """One scope of many points, over shards and tasks by counted queries, gives what a small one gives."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 2))
    table = []
    for k in range(600):
        a, b = (int(x) for x in base[k % 40])
        for bit in rng.integers(0, 120, rng.integers(0, 14)):
            a, b = (a ^ (1 << int(bit)), b) if bit < 60 else (a, b ^ (1 << int(bit - 60)))
        table.append((k % 2, k, a, b, 100 + k % 30))
    df = spark.createDataFrame(table, "scope long, rep long, high long, low long, words int").cache()
    whole = {tuple(r) for r in simhash.near_in_scopes(df, forest=False).collect()}
    parts = [tuple(r) for r in simhash.near_in_scopes(df, forest=False, shard_points=50, task_queries=40).collect()]
    assert len(parts) == len(set(parts)) and set(parts) == whole and len(whole) > 1000
    shards = simhash.plan(df, simhash.RADIUS, 50, 40)
    sent = simhash.route(df, shards, simhash.RADIUS).groupBy("shard", "task", "query").count().collect()
    assert max(shards.tasks.values()) > 1 and {(r.shard, r.task) for r in sent if not r.query} >= {(r.shard, r.task) for r in sent if r.query}


def test_embeddings_recall_and_groups(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((600, 32)) * rng.uniform(0.01, 0.09, (600, 1))
    every = np.concatenate([x, x + noise, np.repeat(x[:3], 40, axis=0)]).astype(np.float32)
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "rep long, embedding array<float>")
    near = every.astype(np.float64) @ every.T.astype(np.float64) >= spherical.THRESHOLD
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    points = df.select("rep", F.col("embedding").alias("vector"))
    got = {tuple(r) for r in spherical.near(points, len(every), forest=False).collect()}
    assert len(got & want) / len(want) > 0.95 and len(got - want) <= 2
    root = groups(len(every), want)
    found = {r.rep: r.kept_rep for r in spherical.near_duplicates(df, id_col="rep").collect()}
    grouped = {k: v for k, v in enumerate(root) if k != v}
    assert np.mean([found.get(k) == v for k, v in grouped.items()]) > 0.93


def test_embedding_groups_are_exact(spark, monkeypatch):
    """No pair is lost, at the threshold either, in whole tables and in blocks."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((1500, 48))
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.9502 * x + np.sqrt(1 - 0.9502**2) * away
    every = np.concatenate([x, y]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<float>")
    want = {1500 + i: i for i in range(1500)}
    for rows in (spherical.EXACT_ROWS, 700):
        monkeypatch.setattr(spherical, "EXACT_ROWS", rows)
        assert {r.vec_id: r.kept_vec_id for r in spherical.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("noise", [0.02, 0.028])
def test_many_near_copies_and_blocks(spark, noise):
    """A third of the vectors are near copies of one, some of them with cosines around the threshold; groups in
    blocks give what whole ones give, and no pair is decided by rounded numbers."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 48)) / np.sqrt(48)
    x[:400] = x[0] + noise * rng.standard_normal((400, 48))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, vector array<float>").repartition(3).cache()
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    true = y @ y.T >= spherical.THRESHOLD
    whole = {tuple(r) for r in spherical.near(df, 1200, forest=False).collect()}
    parts = {tuple(r) for r in spherical.near(df, 1200, forest=False, task_rows=60).collect()}
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(true, 1)), strict=True)}
    assert whole == parts and whole <= want and len(whole) > 0.97 * len(want) and want
    for task_rows in (spherical.TASK_ROWS, 60):
        forest = [tuple(r) for r in spherical.near(df, 1200, task_rows=task_rows).collect()]
        assert groups(1200, forest) == groups(1200, whole)
    assert len(spherical.near(df, 1200).collect()) < 2 * 400


def test_dense_filters_cost_their_copies():
    """What is compared grows with the copies, not with their pairs."""
    rng = np.random.default_rng(10)
    compared = []
    for n in (2_000, 8_000):
        x = spherical._unit(rng.standard_normal(32) + 0.02 * rng.standard_normal((n, 32)))
        x[::10] = spherical._unit(rng.standard_normal((n // 10, 32)))[:]
        x[200:] = np.where((np.arange(200, n) % 10 == 0)[:, None], x[1], x[200:])
        v = spherical._Verifier(x, np.full(n, 1e-4), 0.95, True)
        count = [0]
        plain = v.compare
        v.compare = lambda a, b, itself: (count.__setitem__(0, count[0] + len(a) * len(b)), plain(a, b, itself))
        v.within(np.arange(n), np.zeros(n, np.int64))
        compared.append(count[0] / n)
        assert len(np.unique(v.union.label)) == 1 + 20
    assert compared[1] < 1.5 * compared[0]


@pytest.mark.parametrize("vectors", [2_000, 300_000])
def test_caps_keep_recall_at_the_threshold(vectors):
    rng = np.random.default_rng(5)
    n = spherical.code_size(vectors)
    x = spherical._unit(rng.standard_normal((1500, 48)))
    away = rng.standard_normal((1500, 48))
    away = spherical._unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    y = spherical._unit(0.95 * x + np.sqrt(1 - 0.95**2) * away)
    least = spherical.cap(48, n, 0.95)
    (a, f), (b, g) = spherical.decode(x, n, least), spherical.decode(y, n, least)
    assert len(np.unique(a[np.isin(a * n * n + f, b * n * n + g)])) / 1500 > 0.95


@pytest.mark.parametrize("scale", ["second half small", "second half zero", "falling", "sparse"])
def test_recall_on_uneven_coordinates(spark, scale):
    rng = np.random.default_rng(6)
    d, pairs = 64, 1000
    by = {"second half small": np.where(np.arange(d) < d // 2, 1, 0.2), "second half zero": np.where(np.arange(d) < d // 2, 1, 0), "falling": 1 / np.arange(1, d + 1), "sparse": np.ones(d)}[scale]
    x, away = rng.standard_normal((2, pairs, d)) * by
    if scale == "sparse":
        some = np.argsort(rng.random((pairs, d)), axis=1) < 6
        x, away = x * some, away * some
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * away
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]).astype(np.float32))], "rep long, vector array<float>")
    got = {tuple(r) for r in spherical.near(points, 100_000, forest=False).collect()}  # filters as for a larger table
    assert len(got & {(i, pairs + i) for i in range(pairs)}) / pairs > 0.95


def test_list_decoding_is_complete():
    x = spherical._unit(np.random.default_rng(8).standard_normal((50, 24)))
    one, two = spherical.codebooks(24, 20)
    scores = (x[:, :12] @ one.T)[:, :, None] + (x[:, 12:] @ two.T)[:, None, :]
    row, to = spherical.decode(x, 20, 0.6)
    want = {(r, a * 20 + b) for r, a, b in zip(*np.nonzero(scores >= 0.6), strict=True)}
    assert want <= set(zip(row.tolist(), to.tolist(), strict=True)) and set(row) == set(range(50))


def test_embedding_cases(spark):
    nan, inf = float("nan"), float("inf")
    table = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [2.0, 4.0, 6.0]), (4, None), (None, [1.0, 2.0, 3.0]), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 2.0]), (8, [None, 1.0, 1.0]), (9, []), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in table], "vec_id long, embedding array<float>, rep string, vector string")
    assert sorted(map(tuple, spherical.near_duplicates(df).collect())) == [(2, 1), (3, 1)]
    assert spherical.near_duplicates(df.limit(0)).count() == 0


def brute(texts, k):
    """(id, first_word, n_words, removed) for distinct (id, text)."""
    seen = defaultdict(list)
    split = {}
    for i, t in sorted(set((i, t) for i, t in texts if i is not None and t is not None)):
        w = split[i, t] = t.split()
        for p in range(len(w) - k + 1):
            seen[tuple(w[p : p + k])].append((i, t, p))
    out = []
    flags = defaultdict(dict)
    for places in seen.values():
        if len(places) > 1:
            for n, (i, t, p) in enumerate(places):
                flags[i, t][p] = n > 0
    for (i, t), at in flags.items():
        for removed in (False, True):
            begin = stop = None
            for p in sorted(p for p, f in at.items() if f == removed):
                if begin is not None and p <= stop:
                    stop = p + k
                    continue
                if begin is not None:
                    out.append((i, begin, stop - begin, removed))
                begin, stop = p, p + k
            if begin is not None:
                out.append((i, begin, stop - begin, removed))
    return sorted(out)


@pytest.mark.parametrize("hot", [20_000, 3, 0])
def test_substring_matches_brute_force(spark, docs, rows, hot):
    table = [(i, t) for i, t, _ in rows if i != 8] + [(20, "p q r " * 40), (21, "p q r " * 40 + "end"), (22, "one " * 120)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, substring.find_repeats(df, hot=hot).collect()))
    assert got == brute(table, substring.WINDOW) and got


@pytest.mark.parametrize("together", [None, 2_000])
def test_common_passage_and_repeated_rows(spark, monkeypatch, together):
    """A passage of a third of all documents, whole copies and repeated rows: what travels are first strings."""
    from tests.llm.conftest import sentence

    if together:
        monkeypatch.setattr(substring, "TOGETHER", together)
    passage = sentence(7, 80)
    table = [(k, sentence(100 + k, 20) + " " + passage + " " + sentence(900 + k, 20)) for k in range(150)] + [(k, sentence(100 + k, 120)) for k in range(150, 300)]
    table += [(400 + k, sentence(5, 200)) for k in range(40)] + [(500, sentence(6, 90))] * 30
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for hot in (substring.HOT, 20):
        assert sorted(map(tuple, substring.find_repeats(df, hot=hot).collect())) == brute(table, substring.WINDOW)
    keyed = substring._keyed(df, "doc_id", "text")
    candidates = spark.createDataFrame([(1, k, 0, 20, 31, False) for k in range(150)], "m long, id long, h long, at int, n int, hot boolean")
    sent = substring._pack(candidates.repartition(2), keyed.withColumn("h", F.lit(0).cast("long")), substring.WINDOW)
    rows = sent.groupBy(F.col("packed").isNull()).count().collect()
    if not together:
        assert dict(map(tuple, rows))[False] <= sent.rdd.getNumPartitions() and sum(r["count"] for r in rows) == 150


def test_substring_small_windows(spark):
    rng = random.Random(4)
    table = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted(map(tuple, substring.find_repeats(df, k=7, m=3).collect()))
    assert got == brute(table, 7)


def test_drop_repeats(docs, none, rows):
    left = substring.drop_repeats(docs)
    assert left.columns == docs.columns
    by = defaultdict(list)
    for r in left.collect():
        by[r.doc_id].append(r)
    from tests.llm.conftest import sentence

    shared = sentence(7, 80)
    assert any(r.text and shared in r.text for r in by[8]) and [r.text.split() for r in by[9]] == [sentence(3, 30).split()]
    assert 10 not in by and [r.text for r in by[12]] == ["z"] and by[12][0].n_chars == 1 and len(by[1]) == 2 and len(by[None]) == 2
    assert [r.text for r in by[3]] == [""] and [r.text for r in by[2]] == [None] and by[5][0].n_chars == len(by[5][0].text)
    assert substring.drop_repeats(none).count() == 0 and substring.find_repeats(none).count() == 0
