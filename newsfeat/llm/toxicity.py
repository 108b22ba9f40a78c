"""Toxicity by weak supervision.

1. Voters: words and word beginnings that a bounded sample of labelled rows ties
   to toxic texts (the lexicon), and fixed patterns of shouting.
2. A generative label model over the voters' votes on that sample: strongly
   correlated voters are joined, EM estimates how often each fires on either
   class, and voters with weaker correlations within a class share their say.
   It turns votes into posterior labels.
3. A linear classifier over a wider vocabulary is trained on the posterior
   labels and scores every whole text.

Only step 1 sees labels, and only those of rows outside the held-out fold;
scores depend on the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import crc_mod, read, utf8
from newsfeat.session import written_table

SAMPLE = 20_000        # labelled rows that the models are fitted on, at most
VOCABULARY = 1_500     # words and beginnings the classifier knows, at most
VOTERS = 250           # of them, the lexicon voters of the label model, at most
MIN_DOCS = 5           # sample texts a word or beginning must occur in
MIN_GAIN = 7.0         # log-likelihood gain of a word or beginning over chance
VOTER_PRECISION = 0.95 # share of toxic texts among those a lexicon voter fires on
PREFIXES = (4, 5, 6)   # lengths of word beginnings
FOLDS = 5              # rows whose id has crc32 % FOLDS == 0 are held out
CACHED_WORDS = 100_000

LETTERS = re.compile(r"[^\W\d_]+")
# Shouting and insistence; whatever they are worth, the label model finds out.
PATTERNS = tuple(re.compile(p) for p in (
    r"!{2,}", r"\?{2,}", r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){2}", r"(.)\1{3,}", r"[@#$%&*]{3,}"))


def features_of(word: str) -> list[str]:
    """A lower-case word and its beginnings (marked by a star)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


def fired(text: str) -> list[int]:
    return [i for i, p in enumerate(PATTERNS) if p.search(text)]


# ------------------------------------------------------------------ label model
ALIKE = 0.4            # correlation among toxic texts from which voters are one voter
TOGETHER = 5           # texts in which two voters must fire together for that


def correlations(votes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The voters' correlations within the toxic class (0 for pairs that hardly
    fire together); the clean class has too few votes to tell."""
    v = votes[start == 1].astype(np.float64)
    together = v.T @ v
    mean = v.mean(0) if len(v) else np.zeros(v.shape[1])
    cov = together / max(len(v), 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    out = np.where(together >= TOGETHER, cov / np.maximum(np.outer(sd, sd), 1e-6), 0)
    np.fill_diagonal(out, 0)
    return out


def grouped(votes: np.ndarray, start: np.ndarray, alike: float = ALIKE) -> np.ndarray:
    """Votes of the groups of strongly correlated voters (a word, its beginnings,
    words that go together): a group fires if one of its voters does."""
    near = correlations(votes, start) >= alike
    group = np.arange(votes.shape[1])
    changed = True
    while changed:
        low = np.minimum(group, np.where(near, group[None, :], len(group)).min(1, initial=len(group)))
        changed = bool((low != group).any())
        group = low
    _, number = np.unique(group, return_inverse=True)
    out = np.zeros((len(votes), int(number.max(initial=-1)) + 1), np.float64)
    for voter, g in enumerate(number):
        np.maximum(out[:, g], votes[:, voter], out=out[:, g])
    return out


@dataclass
class LabelModel:
    """Firing rates of each voter on clean (0) and toxic (1) texts, the prior of
    toxic, and the voters' correlations.  A voter that doesn't fire abstains;
    that none fires is a voter of its own, the last one.  Voters that fire on
    the same text share their say as far as they are correlated: of two that
    always fire together each counts half."""

    prior: float
    rates: np.ndarray
    alike: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        says = np.log(self.rates[1] / self.rates[0]) * votes / (1 + votes @ self.alike)
        logit = np.log(self.prior / (1 - self.prior)) + says.sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def with_none(votes: np.ndarray, counted: int) -> np.ndarray:
    """Adds the voter that fires when none of the first ``counted`` does."""
    return np.hstack([votes, 1.0 - votes[:, :counted].max(1, initial=0)[:, None]])


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 20) -> LabelModel:
    """EM from the starting labels; their rates stay as a prior worth as many
    texts as they were counted on, so that the classes keep their meaning."""
    first = np.stack([(votes[start == c].sum(0) + 1.0) / ((start == c).sum() + 2.0) for c in (0, 1)])
    strength = np.array([[(start == c).sum()] for c in (0, 1)], float)
    alike = np.clip(correlations(votes, start), 0, 1)
    model = LabelModel(float(np.clip(start.mean(), 1e-3, 1 - 1e-3)), first, alike)
    for _ in range(rounds):
        q = model.posterior(votes)
        weight = np.stack([1 - q, q])
        rates = (weight @ votes + strength * first) / (weight.sum(1, keepdims=True) + strength)
        model = LabelModel(float(np.clip((q.mean() + start.mean()) / 2, 1e-3, 1 - 1e-3)), np.clip(rates, 1e-5, 1 - 1e-5), alike)
    return model


# ------------------------------------------------------------------- classifier
@dataclass
class Classifier:
    """Feature weights by name; ``patterns`` are those of ``PATTERNS``."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    patterns: list[float] = field(default_factory=lambda: [0.0] * len(PATTERNS))


def fit_linear(rows: list[np.ndarray], size: int, target: np.ndarray, rounds: int = 400, l2: float = 0.5):
    """Weights and bias of a logistic regression on soft labels, sparse rows of
    feature numbers, by gradient steps with per-weight scaling."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    w, mean, square = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(row, w[col], len(rows)), -30, 30)))
        g = np.append(np.bincount(col, (p - target)[row], size) + l2 * w[:-1], (p - target).sum()) / len(rows)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1])


# ---------------------------------------------------------------------- fitting
def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int = SAMPLE) -> DataFrame:
    """``(t, toxic)`` of at most ``limit`` labelled rows outside the held-out
    fold, by hash order of the id, equal texts once.  The ids are bounded, so
    they are broadcast and only the sample's texts are shuffled."""
    ids = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod("doc_id", FOLDS) != 0)
           .groupBy(F.col("doc_id").cast("long").alias("__id"))
           .agg((F.avg("toxic") >= 0.5).cast("int").alias("__toxic"))
           .orderBy(F.xxhash64("__id"), "__id").limit(limit))
    rows = docs.select(F.col(id_col).cast("long").alias("__doc"), utf8(text_col).alias("t"))
    found = rows.join(F.broadcast(ids), F.col("__doc") == F.col("__id")).groupBy("t").agg(F.max("__toxic").alias("toxic"))
    return written_table(found, "toxicity-sample")


def vocabulary(sample: DataFrame, size: int = VOCABULARY) -> list[tuple[str, int, int]]:
    """(feature, toxic texts, clean texts), the most telling first: words and
    beginnings ranked by their signed log-likelihood ratio."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = [Counter(), Counter()]
            for raw, toxic in zip(pdf["t"], pdf["toxic"]):
                words = set(LETTERS.findall(raw.decode("utf-8", "replace").lower()))
                seen[toxic].update({f for w in words for f in features_of(w)})
            for toxic, c in enumerate(seen):
                yield pd.DataFrame({"f": list(c), "toxic": toxic, "n": list(c.values())})

    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    base = float(n1) / (n0 + n1)
    n, pos = F.col("pos") + F.col("neg"), F.col("pos").cast("double")
    gain = pos * F.log((pos + 0.5) / (n * base + 0.5)) + F.col("neg") * F.log((F.col("neg") + 0.5) / (n * (1 - base) + 0.5))
    counts = (sample.mapInPandas(count, "f string, toxic int, n long").groupBy("f")
              .agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("pos"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("neg"))
              .where(n >= MIN_DOCS).withColumn("gain", gain).where(F.col("gain") >= MIN_GAIN))
    return [(r.f, r.pos, r.neg) for r in counts.orderBy(F.desc("gain"), "f").limit(size).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        limit: int = SAMPLE) -> Classifier:
    """The classifier; without labels of both classes it is a constant."""
    sample = training_sample(docs, labels, id_col, text_col, limit)
    ranked = vocabulary(sample)
    if not ranked:
        r = sample.agg(F.avg("toxic").alias("m")).first()
        return Classifier(30.0 if r.m == 1 else -30.0)
    number = {f: i for i, (f, _, _) in enumerate(ranked)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hits = []
            for raw in pdf["t"]:
                text = raw.decode("utf-8", "replace")
                words = set(LETTERS.findall(text.lower()))
                own = {number[f] for w in words for f in features_of(w) if f in number}
                hits.append(sorted(own) + [len(number) + i for i in fired(text)])
            yield pd.DataFrame({"hits": hits, "toxic": pdf["toxic"]})

    rows = sample.mapInPandas(vectors, "hits array<int>, toxic int").toPandas()  # at most ``limit`` short rows
    hits = [np.asarray(h, np.int64) for h in rows["hits"]]
    size, start = len(number) + len(PATTERNS), rows["toxic"].to_numpy()
    lexicon = [i for i, (_, pos, neg) in enumerate(ranked) if pos >= VOTER_PRECISION * (pos + neg)][:VOTERS]
    voter = {v: k for k, v in enumerate([*lexicon, *range(len(number), size)])}
    votes = np.zeros((len(hits), len(voter)), np.float32)
    for i, h in enumerate(hits):
        votes[i, [voter[x] for x in h.tolist() if x in voter]] = 1
    lexicon_groups, pattern_groups = grouped(votes[:, :len(lexicon)], start), grouped(votes[:, len(lexicon):], start)
    votes = with_none(np.hstack([lexicon_groups, pattern_groups]), lexicon_groups.shape[1])
    target = fit_label_model(votes, start).posterior(votes)
    weights, bias = fit_linear(hits, size, target)
    return Classifier(bias, {f: float(weights[i]) for f, i in number.items()},
                      [float(x) for x in weights[len(number):]])


# ---------------------------------------------------------------------- scoring
class _Weights(dict):
    """(feature, weight) pairs of words, worked out on first use."""

    def __init__(self, model: Classifier):
        super().__init__()
        self.model = model.weights

    def __missing__(self, word: str) -> tuple:
        found = self[word] = tuple((f, self.model[f]) for f in features_of(word) if f in self.model)
        return found


def score_text(text: str, model: Classifier, known: _Weights) -> float:
    logit = model.bias + sum(model.patterns[i] for i in fired(text))
    hits = {f: w for pairs in map(known.__getitem__, set(LETTERS.findall(text.lower()))) if pairs for f, w in pairs}
    if len(known) > CACHED_WORDS:
        known.clear()
    return float(1 / (1 + np.exp(-np.clip(logit + sum(hits[f] for f in sorted(hits)), -30, 30))))


def score(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each whole text (null and empty
    texts: that of no evidence).  Rows and other columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY entries at most

    @F.pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Weights(sent.value)
        for batch in texts:
            yield batch.map(lambda raw: score_text(raw.decode("utf-8", "replace"), sent.value, known)).astype(float)

    return docs.withColumn(score_col, run(utf8(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    A null id is in the held-out fold (its remainder counts as 0); repeated rows
    get the same score; an empty table gives no rows; conflicting labels of an
    id are decided by their mean; without any label all scores are near 0.
    """
    scored = score(docs.select(id_col, text_col), fit(docs, labels, id_col, text_col), text_col, "__score")
    return scored.select(F.col(id_col).alias("doc_id"), (crc_mod(id_col, FOLDS) == 0).alias("held_out"),
                         F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic."""
    scored = score(docs, fit(docs, labels, id_col, text_col), text_col, "__score")
    return scored.where("__score < 0.5").select(*docs.columns)


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
