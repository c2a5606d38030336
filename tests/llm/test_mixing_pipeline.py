"""Mixing, and the pipeline as a whole."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from tesserae.llm import mixing, quality, simhash, substring


def balanced(rows, targets=None, flatten=mixing.FLATTEN):
    """Rates of (source, tokens) by gradient of the dual on plain arrays, a for each source and b by bisection."""
    t = np.array([x for _, x in rows], float)
    source = np.array([str(s) for s, _ in rows])
    use = t > 0
    names = sorted(set(source[use]))
    total = t[use].sum()
    have = {s: t[source == s].sum() for s in names}
    weight = {s: have[s] ** flatten if targets is None else targets.get(s, 0) for s in names}
    names = [s for s in names if weight[s] > 0]
    kept = use & np.isin(source, names)
    z = np.log1p(t) - (t[kept] * np.log1p(t[kept])).sum() / t[kept].sum()
    norm = sum(weight[s] for s in names)

    def rates(b):
        r = np.zeros(len(t))
        for s in names:
            m = use & (source == s)
            e = np.exp(b * z[m])
            r[m] = e * weight[s] / norm * total / (t[m] * e).sum()
        return r

    low, high = -20.0, 20.0
    for _ in range(200):
        b = (low + high) / 2
        low, high = (low, b) if (rates(b) * t * z).sum() + mixing.PENALTY * b * total > 0 else (b, high)
    return rates(b)


def test_rates_match_and_meet_the_targets(sf):
    docs = sf("documents")
    got = mixing.mix_rates(docs).orderBy("doc_id").collect()
    want = balanced([(r.source, r.n_tokens) for r in got])
    assert np.allclose([r.rate for r in got], want, rtol=1e-5)
    total = sum(r.n_tokens for r in got)
    have, mixed, copied = Counter(), Counter(), Counter()
    for r in got:
        have[r.source] += r.n_tokens
        mixed[r.source] += r.rate * r.n_tokens
        copied[r.source] += r.copies * r.n_tokens
    norm = sum(math.sqrt(v) for v in have.values())
    for s, v in have.items():
        assert mixed[s] == pytest.approx(math.sqrt(v) / norm * total, rel=1e-6) and abs(r.copies - r.rate) < 1
    assert sum(copied.values()) == pytest.approx(total, rel=0.1)
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert all(words[r.doc_id] == r.n_tokens for r in got)


def test_mixing_cases(docs, none, rows):
    got = mixing.mix_rates(docs, {"a": 3.0, "b": 1.0, None: 1.0, "absent": 5.0, "c": 0.0}).collect()
    assert len(got) == len(rows)
    assert all(r.copies == 0 and r.rate == 0 for r in got if r.n_tokens == 0 or r.source == "c")
    want = balanced([(r.source, r.n_tokens) for r in got], {"a": 3.0, "b": 1.0, "None": 1.0})
    assert np.allclose([r.rate for r in got], want, rtol=1e-5)
    same = [r.copies for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    out = mixing.mix_documents(docs)
    copies = {(r.doc_id, r.n_tokens): r.copies for r in mixing.mix_rates(docs).collect()}
    times = Counter((r.doc_id, len(r.text.split())) for r in out.collect())
    assert out.columns == docs.columns and times[1, 7] == 2 * copies[1, 7] and all(times[k] == v for k, v in copies.items() if k != (1, 7))
    assert mixing.mix_rates(none).count() == 0 and mixing.mix_documents(none).count() == 0
    assert mixing.mix_documents(docs, {}).count() == 0


def test_pipeline_against_its_decisions(spark, sf):
    """run() against the stages' decisions applied by plain Python."""
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = sf("documents", "sf0.001"), sf("labels", "sf0.001")
    text = {r.doc_id: r for r in docs.collect()}
    keep = {r.doc_id for r in quality.rate(docs, labels).collect() if r.keep}
    left = spark.createDataFrame([text[i] for i in keep], docs.schema)
    gone = {r.doc_id for r in simhash.near_duplicates(left).collect()}
    left = spark.createDataFrame([text[i] for i in keep - gone], docs.schema)
    cut = defaultdict(set)
    for r in substring.find_repeats(left).collect():
        if r.removed:
            cut[r.doc_id] |= set(range(r.first_word, r.first_word + r.n_words))
    words = {i: [w for k, w in enumerate(text[i].text.split()) if k not in cut[i]] for i in keep - gone}
    words = {i: w for i, w in words.items() if w}
    rates = dict(zip(words, balanced([(text[i].source, len(w)) for i, w in words.items()]), strict=True))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    times = Counter(r.doc_id for r in got)
    assert set(times) <= set(words) and all(math.floor(rates[i]) <= times[i] <= math.ceil(rates[i]) for i in words)
    assert all(r.round_trip and r.n_tokens > 0 for r in got)
    assert gone and cut and len(keep) < len(text)


def test_near_dedup_drops_texts_in_another_order(spark):
    from tests.llm.test_dedup import reordered

    docs = spark.createDataFrame(reordered(30), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == list(range(0, 60, 2))


def test_stages_keep_the_columns(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert name == "bpe_encode" or out.columns == docs.columns
            assert (out.count() == 0) == (table is none)


def test_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
