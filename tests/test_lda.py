"""LDA with term-keyed topics against a plain dense EM, and its bound."""

import math
import random

import numpy as np
import pytest

from newsfeat.operators import lda


def corpus(spark, n=200, seed=1):
    rng = random.Random(seed)
    words = [[f"t{g}w{i}" for i in range(15)] for g in range(3)]
    rows = []
    for d in range(n):
        g = d % 3
        rows.append((d, [rng.choice(words[g if rng.random() < 0.9 else rng.randrange(3)]) for _ in range(rng.randint(1, 30))]))
    return rows, spark.createDataFrame(rows + [(n, []), (n + 1, None)], "doc_id long, terms array<string>")


def plain_em(rows, k, iters, weights, terms, inner):
    """Dense counts, one document at a time."""
    index = {t: i for i, t in enumerate(terms)}
    counts = np.zeros((len(rows), len(terms)))
    for d, own in rows:
        for t in own:
            counts[d, index[t]] += 1
    alpha, bounds, gamma = 50 / k, [], None
    for _ in range(iters):
        beta = weights / weights.sum(axis=0)
        gamma = alpha + np.repeat(counts.sum(axis=1)[:, None] / k, k, axis=1) if gamma is None else gamma
        weights, bound, logs = np.zeros_like(weights), 0.0, 0.0
        for d in range(len(rows)):
            g = gamma[d]
            for _ in range(inner):
                w = beta * np.exp(lda.digamma(g) - lda.digamma(g.sum()))
                g = alpha + (counts[d][:, None] * w / w.sum(axis=1, keepdims=True)).sum(axis=0)
            log_theta = lda.digamma(g) - lda.digamma(g.sum())
            w = beta * np.exp(log_theta)
            weights += counts[d][:, None] * w / w.sum(axis=1, keepdims=True)
            bound += math.lgamma(k * alpha) - k * math.lgamma(alpha) + ((alpha - g) * log_theta).sum() - math.lgamma(g.sum()) \
                + sum(math.lgamma(x) for x in g) + (counts[d] * np.log(w.sum(axis=1))).sum()
            logs += log_theta.sum()
            gamma[d] = g
        bounds.append(bound)
        alpha = lda.new_alpha(alpha, len(rows), k, logs)
    return weights, gamma, bounds, alpha


def test_special_functions():
    x = np.array([0.01, 0.3, 1.0, 2.5, 7.0, 40.0])
    assert np.allclose(lda.gammaln(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    h = 1e-5
    assert np.allclose(lda.digamma(x[1:]), [(math.lgamma(v + h) - math.lgamma(v - h)) / 2 / h for v in x[1:]], atol=1e-5)
    assert np.allclose([lda.trigamma(v) for v in x[1:]], (lda.digamma(x[1:] + h) - lda.digamma(x[1:] - h)) / 2 / h, atol=1e-5)


def test_equals_plain_em(spark, monkeypatch):
    monkeypatch.setattr(lda, "TOLERANCE", 0.0)
    rows, corp = corpus(spark)
    terms = sorted({t for _, own in rows for t in own})
    start = {r.term: r.weights for r in lda.initial_weights(spark.createDataFrame([(t,) for t in terms], "term string"), 3, 7).collect()}
    # One E-step round a time, so that both stop alike.
    model = lda.fit_lda(corp, 3, 6, 7, block_entries=300, inner=1, terms_a_block=7)
    weights, gamma, bounds, alpha = plain_em(rows, 3, 6, np.array([start[t] for t in terms]), terms, 1)
    assert np.allclose(model.bounds, bounds, rtol=1e-9) and model.alpha == pytest.approx(alpha, rel=1e-6)
    got = {r.term: r.weights for r in model.terms.collect()}
    assert np.allclose([got[t] for t in terms], weights, rtol=1e-6, atol=1e-9)
    docs = {r.doc_id: r.gamma for r in model.docs.collect()}
    assert np.allclose([docs[d] for d, _ in rows], gamma, rtol=1e-6)


def test_bound_rises_and_topics_are_found(spark):
    rows, corp = corpus(spark, 150, 2)
    model = lda.fit_lda(corp, 3, 25, 3, block_entries=500)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.bounds, model.bounds[1:])) and len(model.bounds) > 3
    doc_topics, terms = lda.lda_topics(corp, 3, 25, 3, block_entries=500)
    got = {r.doc_id: r for r in doc_topics.collect()}
    assert got[150].topic is None and got[151].topic is None and len(got) == 152
    assert all(1 <= got[d].topic <= 3 and 0 < got[d].prob <= 1 for d, _ in rows)
    summary = {r.topic: r.terms.split(", ") for r in terms.collect()}
    assert set(summary) == {1, 2, 3} and all(len(t) == 5 for t in summary.values())
    assert all(len({w[:2] for w in t}) == 1 for t in summary.values())
    again = {r.doc_id: r.topic for r in lda.lda_topics(corp, 3, 25, 3, block_entries=500)[0].collect()}
    assert again == {d: r.topic for d, r in got.items()}


def test_no_document_with_terms(spark):
    empty = spark.createDataFrame([(1, []), (None, ["a"])], "doc_id long, terms array<string>")
    doc_topics, terms = lda.lda_topics(empty, 2)
    assert sorted((r.doc_id or 0, r.topic) for r in doc_topics.collect()) == [(0, None), (1, None)] and terms.collect() == []
    assert lda.lda_topics(empty.limit(0), 2)[0].count() == 0


def test_block_in_stretches_equals_whole_block():
    rng = np.random.default_rng(1)
    docs = np.unique(np.sort(rng.integers(0, 60, 900)), return_inverse=True)[1]
    i = np.unique(rng.integers(0, 100, 900), return_inverse=True)[1]
    n, gamma = rng.integers(1, 5, 900).astype(float), np.ones((docs.max() + 1, 4))
    beta = rng.random((i.max() + 1, 4))
    whole = lda.block_step(docs, i, n, beta, gamma, 0.5, step=10_000)
    for step in (1, 50, 900):
        assert all(np.allclose(x, y, rtol=1e-10) for x, y in zip(whole, lda.block_step(docs, i, n, beta, gamma, 0.5, step=step)))


def test_tables_of_earlier_iterations_are_deleted(spark):
    import os

    from newsfeat.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(base))
    lda.fit_lda(corpus(spark, 20)[1], 3, 4, 7)
    left = [x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before]
    assert sorted(left) == ["newsfeat-lda-blocks", "newsfeat-lda-gammas", "newsfeat-lda-terms", "newsfeat-lda-weights"]
