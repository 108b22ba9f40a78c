"""Held-out accuracy, the label model, and odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from newsfeat.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, score string, predicted string"


def corpus(n=1500, seed=4):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    bad = ["zorgblat", "quixnak", "vromfud"]
    stem = ["drekk" + "".join(rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 8 == 0
        words = [rng.choice(clean) for _ in range(rng.randint(5, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(bad + stem).title())
        docs.append((i, " ".join(words) + "!!" * (i % 5 == 0), "en", "s", "clash", "clash"))
        if i % 3:
            labels.append((i, 0, int(toxic)))
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    odd = [(None, None, None, None, "", ""), (9000, "", "", "", "", ""), (9001, "word " * 200_000, "", "", "", ""),
           docs[8], docs[8]]
    got = tox.toxicity(spark.createDataFrame(docs + odd, DOCS),
                       spark.createDataFrame(labels + [(None, 1, 1), (3, 0, None), (7, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + 5
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 1500 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held)
    assert right > 0.97
    assert {r.predicted for r in got if r.doc_id in (9000, 9001)} == {0}


def test_no_labels_and_empty_tables(spark):
    docs, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in tox.toxicity(spark.createDataFrame(docs, DOCS), none).collect()} == {0}
    assert tox.toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_label_model_finds_rates_and_joins_copies():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.2
    rates = np.array([[0.02, 0.05, 0.3, 0.01], [0.6, 0.5, 0.3, 0.4]])
    votes = (rng.random((4000, 4)) < rates[truth.astype(int)]).astype(np.float32)
    start = np.where(rng.random(4000) < 0.1, ~truth, truth).astype(int)
    doubled = np.hstack([votes, votes[:, :1] * (rng.random((4000, 1)) < 0.9)])  # a voter that follows the first
    assert tox.grouped(doubled, truth.astype(int)).shape == (4000, 4)
    model = tox.fit_label_model(tox.with_none(votes, 4), truth.astype(int))
    assert model.rates[1, :4] == pytest.approx(rates[1], abs=0.2)
    model = tox.fit_label_model(tox.with_none(votes, 4), start)
    assert ((model.posterior(tox.with_none(votes, 4)) > 0.5) == truth).mean() > 0.9


def test_drop_toxic_keeps_columns(spark):
    docs, labels = corpus(600)
    df = spark.createDataFrame(docs, DOCS)
    out = tox.drop_toxic(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert len(kept & {i for i in range(600) if i % 8}) == 525 and len(kept) < 540


# ------------------------------------------------ the whole query by plain loops
def plain_fired(text):
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    names = {f for w in words for f in [w, *(w[:n] + "*" for n in tox.PREFIXES if len(w) > n)]}
    return names | {f"!{i}" for i, p in enumerate(tox.PATTERNS) if p.search(text)}


def plain_correlation(votes, toxic, a, b):
    rows = [v for v, t in zip(votes, toxic) if t]
    both = sum(v[a] * v[b] for v in rows)
    if a == b or both < tox.TOGETHER:
        return 0.0
    ma, mb = sum(v[a] for v in rows) / len(rows), sum(v[b] for v in rows) / len(rows)
    spread = math.sqrt(ma - ma * ma) * math.sqrt(mb - mb * mb)
    return (both / len(rows) - ma * mb) / max(spread, 1e-6)


def plain_groups(votes, toxic, size):
    """Votes of voters that correlate strongly, directly or through others, joined."""
    near = {a: [b for b in range(size) if plain_correlation(votes, toxic, a, b) >= tox.ALIKE] for a in range(size)}
    left, groups = set(range(size)), []
    while left:
        reached, todo = set(), [min(left)]
        while todo:
            a = todo.pop()
            if a not in reached:
                reached.add(a)
                todo += near[a]
        groups.append(reached)
        left -= reached
    return [[max(v[a] for a in g) for g in groups] for v in votes]


def plain_posterior(votes, prior, rates, alike):
    out = []
    for v in votes:
        logit = math.log(prior / (1 - prior))
        for a, x in enumerate(v):
            if x:
                logit += math.log(rates[1][a] / rates[0][a]) / (1 + sum(alike[b][a] for b, y in enumerate(v) if y))
        out.append(1 / (1 + math.exp(-max(-30, min(30, logit)))))
    return out


def plain_scores(docs, labels):
    marks = defaultdict(list)
    for i, _, toxic in labels:
        if i is not None and toxic is not None and zlib.crc32(str(i).encode()) % 5:
            marks[i].append(toxic)
    sample = {}
    for i, text in docs:
        if i in marks:
            toxic = int(sum(marks[i]) / len(marks[i]) >= 0.5)
            sample[text or ""] = max(toxic, sample.get(text or "", 0))
    texts, toxic = list(sample), list(sample.values())
    seen = [plain_fired(t) for t in texts]
    pos, neg = (Counter(f for s, t in zip(seen, toxic) if t == c for f in s if f[0] != "!") for c in (1, 0))
    base = sum(toxic) / len(toxic)
    known = []
    for f in set(pos) | set(neg):
        p, q = pos[f], neg[f]
        gain = p * math.log((p + .5) / ((p + q) * base + .5)) + q * math.log((q + .5) / ((p + q) * (1 - base) + .5))
        if p + q >= tox.MIN_DOCS and gain >= tox.MIN_GAIN:
            known.append(f)
    patterns = [f"!{i}" for i in range(len(tox.PATTERNS))]
    lexicon = [f for f in known if pos[f] >= tox.VOTER_PRECISION * (pos[f] + neg[f])]
    assert known and len(known) < tox.VOCABULARY and len(lexicon) < tox.VOTERS
    words, marks = ([[float(f in s) for f in names] for s in seen] for names in (lexicon, patterns))
    words, marks = plain_groups(words, toxic, len(lexicon)), plain_groups(marks, toxic, len(patterns))
    votes = [a + b + [1.0 - max(a)] for a, b in zip(words, marks)]
    size = len(votes[0])
    alike = [[min(1, max(0, plain_correlation(votes, toxic, a, b))) for b in range(size)] for a in range(size)]
    n = [toxic.count(0), toxic.count(1)]
    first = [[(sum(v[a] for v, t in zip(votes, toxic) if t == c) + 1) / (n[c] + 2) for a in range(size)] for c in (0, 1)]
    prior, rates = base, first
    for _ in range(20):
        q = plain_posterior(votes, prior, rates, alike)
        weight = [[1 - x for x in q], q]
        rates = [[min(1 - 1e-5, max(1e-5, (sum(w * v[a] for w, v in zip(weight[c], votes)) + n[c] * first[c][a])
                                    / (sum(weight[c]) + n[c]))) for a in range(size)] for c in (0, 1)]
        prior = (sum(q) / len(q) + base) / 2
    target = plain_posterior(votes, prior, rates, alike)
    names = known + patterns
    rows = [[f for f in names if f in s] for s in seen]
    w, mean, square = (dict.fromkeys(names + [None], 0.0) for _ in range(3))
    for step in range(1, 401):
        g = {f: 0.5 * w[f] for f in names} | {None: 0.0}
        for r, t in zip(rows, target):
            off = 1 / (1 + math.exp(-(w[None] + sum(w[f] for f in r)))) - t
            for f in [*r, None]:
                g[f] += off
        for f, x in g.items():
            x /= len(rows)
            mean[f], square[f] = 0.9 * mean[f] + 0.1 * x, 0.99 * square[f] + 0.01 * x * x
            w[f] -= 0.1 * (mean[f] / (1 - 0.9**step)) / (math.sqrt(square[f] / (1 - 0.99**step)) + 1e-8)
    return [1 / (1 + math.exp(-(w[None] + sum(w.get(f, 0.0) for f in plain_fired(text or ""))))) for _, text in docs]


def test_whole_query_same_as_plain_version(spark, tmp_path):
    docs, labels = corpus(240, seed=6)
    rows = [d[:2] for d in docs] + [(None, None), (500, ""), (501, "Zorgblat drekkaei !!"), (8, "drekkooo again"), docs[16][:2]]
    labels = labels + [(8, 0, 0), (8, 0, 1), (None, 0, 1), (3, 0, None), (501, 0, 1)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.score, r.predicted) for r in tox.q_toxicity(spark, str(tmp_path)).collect())
    want = sorted((-1 if i is None else i, i is None or zlib.crc32(str(i).encode()) % 5 == 0, s, int(s >= 0.5))
                  for (i, _), s in zip(rows, plain_scores(rows, labels)))
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-6)
    assert {x[3] for x in got} == {0, 1}
