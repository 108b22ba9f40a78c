"""LDA by batch variational EM with topics keyed by term.

The topic weights are a table of term blocks, dealt by a hash of the term, never
collected.  Documents are dealt to blocks of about ``BLOCK_ENTRIES`` (document,
term) counts, packed once; an E-step goes through a block ``STEP_ENTRIES`` counts
at a time.  A table of an iteration is deleted as soon as the next one replaces
it.  An iteration sends each document block the weights
of its own terms, runs the variational E-step on the block and sends the partial
weights back to the term blocks, which add them up; only k totals and two sums
go to the driver.  The per-document parameters stay in the written table between
iterations, so each E-step starts where the last one ended and the bound never
falls.  ``alpha`` is re-estimated by Newton steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.operators.textmining import concat_ranked, top_k_per_group
from newsfeat.session import drop_table, written_table

BLOCK_ENTRIES = 1_000_000  # (document, term) counts of a block, about
STEP_ENTRIES = 100_000    # counts whose k shares are held at a time, about
INNER = 10                # E-step rounds of a document within an iteration, at most
TOLERANCE = 1e-4          # relative gain of the bound that ends the iterations
TERMS_A_BLOCK = 50_000    # terms of a term block, about
TINY = 1e-100


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        out -= np.where(x < 6, 1 / x, 0)
        x = np.where(x < 6, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out += 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def gammaln(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(7):
        out -= np.where(x < 7, np.log(x), 0)
        x = np.where(x < 7, x + 1, x)
    r = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / x


def e_step(docs: np.ndarray, n: np.ndarray, beta: np.ndarray, gamma: np.ndarray, alpha: float,
           inner: int = INNER) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One block.  ``docs`` (sorted document numbers), ``n`` and ``beta`` (k
    weights) are parallel over the counts, ``gamma`` has a row per document.
    Returns the new gamma, each count's share of the topics times ``n``, the
    bound of the block and the sum of all expected log topic proportions."""
    ends = np.flatnonzero(np.r_[docs[1:] != docs[:-1], True]) + 1
    spans = list(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()))
    gamma, moving = gamma.copy(), np.arange(len(spans))

    def expected(gamma: np.ndarray) -> np.ndarray:
        return digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))

    for _ in range(inner):  # two products per document that still moves
        theta, new = np.exp(expected(gamma[moving])), np.empty((len(moving), gamma.shape[1]))
        for at, d in enumerate(moving.tolist()):
            first, end = spans[d]
            own = beta[first:end]
            new[at] = theta[at] * ((n[first:end] / (own @ theta[at] + TINY)) @ own)
        new += alpha
        moved = np.abs(new - gamma[moving]).mean(axis=1)
        gamma[moving] = new
        moving = moving[moved >= 1e-3]
        if not len(moving):
            break
    log_theta = expected(gamma)
    phi = np.exp(log_theta)[docs]
    phi *= beta
    norm = phi.sum(axis=1) + TINY
    phi *= (n / norm)[:, None]
    k = gamma.shape[1]
    bound = (len(gamma) * (gammaln(np.array(k * alpha)) - k * gammaln(np.array(alpha))) + ((alpha - gamma) * log_theta).sum()
             - gammaln(gamma.sum(axis=1)).sum() + gammaln(gamma).sum() + (n * np.log(norm)).sum())
    return gamma, phi, float(bound), float(log_theta.sum())


def _stretches(docs: np.ndarray, most: int):
    """``(first, end)`` of stretches of whole documents, about ``most`` counts each."""
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    at = np.searchsorted(starts, np.arange(0, len(docs), most))
    firsts = starts[np.unique(at[at < len(starts)])]
    return zip(firsts.tolist(), [*firsts[1:].tolist(), len(docs)])


def block_step(docs: np.ndarray, i: np.ndarray, n: np.ndarray, beta: np.ndarray, gamma: np.ndarray, alpha: float,
               inner: int = INNER, step: int = STEP_ENTRIES) -> tuple[np.ndarray, np.ndarray, float, float]:
    """``e_step`` over a block, a stretch of documents at a time.  ``beta`` has a
    row per term of the block, ``i`` the term of each count; returns the new gamma,
    the partial weights of the terms, the bound and the sum of logs."""
    gamma, stats, bound, logs = gamma.copy(), np.zeros(beta.shape), 0.0, 0.0
    for first, end in _stretches(docs, step):
        own, terms = slice(docs[first], docs[end - 1] + 1), i[first:end]
        gamma[own], phi, some_bound, some_logs = e_step(docs[first:end] - docs[first], n[first:end], beta[terms], gamma[own], alpha, inner)
        by_term = np.argsort(terms, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(terms[by_term]) > 0])
        stats[terms[by_term][starts]] += np.add.reduceat(phi[by_term], starts, axis=0)
        bound, logs = bound + some_bound, logs + some_logs
    return gamma, stats, bound, logs


def new_alpha(alpha: float, docs: int, k: int, log_theta: float) -> float:
    """The symmetric prior that maximises the bound, by Newton steps on its log."""
    a = alpha
    for _ in range(100):
        d1 = docs * k * float(digamma(np.array(k * a)) - digamma(np.array(a))) + log_theta
        d2 = docs * (k * k * trigamma(k * a) - k * trigamma(a))
        step = d1 / (d2 * a + d1) if d2 * a + d1 else 0.0
        a_new = math.exp(math.log(a) - max(-2.0, min(2.0, step)))
        if not math.isfinite(a_new) or a_new < 1e-6 or a_new > 1e6:
            return alpha
        if abs(a_new - a) < 1e-8 * a:
            return a_new
        a = a_new
    return a


@dataclass
class Lda:
    """``terms(term, weights)``: a row per term, k topic weights; ``docs(doc_id,
    gamma)``: k document parameters; ``bounds``: the bound of each iteration."""

    k: int
    terms: DataFrame
    docs: DataFrame
    alpha: float
    bounds: list[float]


def initial_weights(terms: DataFrame, k: int, seed: int) -> DataFrame:
    """``terms`` with random ``weights``, a hash of term, topic and seed each."""
    def uniform(topic: int):
        return (F.pmod(F.xxhash64("term", F.lit(topic), F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))

    return terms.withColumn("weights", F.array(*[uniform(t) for t in range(k)]))


def _matrix(data: bytes, k: int) -> np.ndarray:
    return np.frombuffer(data, float).reshape(-1, k)


_BLOBS = "block long, part long, data binary, sums array<double>"


_BLOB_NAMES = ["block", "part", "data", "sums"]


@dataclass
class _Packed:
    """``docs(block, ids, d, i, n, parts, terms)``: a row per document block, its
    terms in the order of the term blocks they belong to; ``terms(part, block,
    pos)``: where these stand in a term block, and ``names(part, names)``."""

    docs: DataFrame
    terms: DataFrame
    names: DataFrame
    n_docs: int
    blocks: int
    parts: int


def _packed(corp: DataFrame, block_entries: int, terms_a_block: int) -> _Packed:
    counts = written_table(corp.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term")
                           .agg(F.count(F.lit(1)).alias("n")), "lda-counts")
    entries, n_terms, n_docs = counts.agg(F.count(F.lit(1)), F.approx_count_distinct("term"), F.count_distinct("doc_id")).first()
    blocks, parts = max(1, -(-entries // block_entries)), max(1, -(-n_terms // terms_a_block))
    dealt = counts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("long")).withColumn(
        "part", F.pmod(F.xxhash64(F.lit(1), "term"), F.lit(parts)).cast("long"))
    id_type = corp.schema["doc_id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        d, ids = pd.factorize(pdf["doc_id"], sort=True)
        words = pdf[["part", "term"]].drop_duplicates().sort_values(["part", "term"])
        i = pd.Index(words["term"]).get_indexer(pdf["term"])
        order = np.lexsort((i, d))
        return pd.DataFrame([{"block": int(pdf["block"].iloc[0]), "ids": list(ids), "d": d[order].astype(np.int32),
                              "i": i[order].astype(np.int32), "n": pdf["n"].to_numpy()[order],
                              "parts": words["part"].to_numpy(), "terms": words["term"].tolist()}])

    docs = written_table(dealt.repartition(2 * blocks, "block").groupBy("block").applyInPandas(
        pack, f"block long, ids array<{id_type}>, d array<int>, i array<int>, n array<long>, parts array<long>, terms array<string>"),
        "lda-blocks")
    drop_table(counts)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["term"]))
        at, part = pd.Index(names), int(pdf["part"].iloc[0])
        rows = [(part, int(b), at.get_indexer(own.sort_values("i")["term"]).astype(np.int32), None) for b, own in pdf.groupby("block")]
        return pd.DataFrame([*rows, (part, -1, None, names)], columns=["part", "block", "pos", "names"])

    members = docs.select("block", F.posexplode(F.arrays_zip("parts", "terms")).alias("i", "x")).select("block", "i", "x.*").toDF(
        "block", "i", "part", "term")
    placed = written_table(members.repartition(2 * parts, "part").groupBy("part").applyInPandas(
        place, "part long, block long, pos array<int>, names array<string>"), "lda-terms")
    return _Packed(docs.drop("terms"), placed.where("block >= 0").drop("names"), placed.where("block < 0").select("part", "names"),
                   n_docs, blocks, parts)


def _met(left: DataFrame, right: DataFrame, key: str, count: int, step) -> DataFrame:
    """Cogroup of two sides.  A fixed number of partitions: small blobs are costly
    ones, so they aren't merged into few tasks."""
    sides = [side.repartition(2 * count, key).groupBy(key) for side in (left, right)]
    return sides[0].cogroup(sides[1]).applyInPandas(step, _BLOBS)


def fit_lda(corp: DataFrame, k: int, max_iter: int = 20, seed: int = 1, alpha: float | None = None,
            block_entries: int = BLOCK_ENTRIES, inner: int = INNER, terms_a_block: int = TERMS_A_BLOCK) -> Lda:
    """Variational EM on the unigram counts of ``corp(doc_id, terms)``.

    ``alpha`` starts at 50 / k.  Rows without an id count as no document; rows
    that share an id are one document; documents without terms take no part; no
    document with a term: no topics and no bound."""
    spark = corp.sparkSession
    packed = _packed(corp.where("doc_id IS NOT NULL AND size(terms) > 0"), block_entries, terms_a_block)
    alpha = alpha or 50.0 / k
    bounds: list[float] = []

    def shares(part: int, weights: np.ndarray, index: pd.DataFrame) -> pd.DataFrame:
        """A term block's own weights (block -1) and the rows of each document block."""
        rows = [(int(b), part, weights[np.asarray(pos)].tobytes(), None) for b, pos in zip(index["block"], index["pos"])]
        return pd.DataFrame([*rows, (-1, part, weights.tobytes(), weights.sum(axis=0))], columns=_BLOB_NAMES)

    def first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return shares(int(right["part"].iloc[0]), np.stack(left.sort_values("pos")["weights"].to_list()), right)

    def m_step(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        weights = np.zeros((max(int(np.max(pos)) for pos in right["pos"]) + 1, k))
        pos_of = dict(zip(right["block"], right["pos"]))
        for block, data in sorted(zip(left["block"], left["data"])):
            weights[np.asarray(pos_of[block])] += _matrix(data, k)
        return shares(int(right["part"].iloc[0]), weights, right)

    terms = packed.names.select("part", F.posexplode("names").alias("pos", "term"))
    start = initial_weights(terms, k, seed).select("part", "pos", "weights")
    weights = written_table(_met(start, packed.terms, "part", packed.parts, first), "lda-weights")
    state = None
    for _ in range(max_iter if packed.n_docs else 0):
        totals = _added(weights.where("block < 0"), k)
        a = alpha

        def e(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            own = right.iloc[0]
            docs, i, n, parts = np.asarray(own["d"]), np.asarray(own["i"]), np.asarray(own["n"], float), np.asarray(own["parts"])
            left = left.sort_values("part")
            beta = np.concatenate([_matrix(x, k) for x in left["data"][left["part"] >= 0]]) / totals
            before = left["data"][left["part"] < 0]
            gamma = _matrix(before.iloc[0], k) if len(before) else np.repeat((a + np.bincount(docs, n) / k)[:, None], k, axis=1)
            gamma, stats, bound, log_theta = block_step(docs, i, n, beta, gamma, a, inner)
            ends = np.flatnonzero(np.r_[np.diff(parts) > 0, True]) + 1
            rows = [(int(own["block"]), int(parts[lo]), stats[lo:hi].tobytes(), None) for lo, hi in zip(np.r_[0, ends[:-1]], ends)]
            return pd.DataFrame([*rows, (int(own["block"]), -1, gamma.tobytes(), np.array([bound, log_theta]))],
                                columns=_BLOB_NAMES)

        sent = weights.where("block >= 0")
        if state is not None:
            sent = sent.unionByName(state.where("part < 0"))
        replaced = [weights, *([state] if state is not None else [])]
        state = written_table(_met(sent, packed.docs.drop("ids"), "block", packed.blocks, e), "lda-documents")
        for table in replaced:
            drop_table(table)
        bound, log_theta = _added(state.where("part < 0"), 2)
        weights = written_table(_met(state.where("part >= 0"), packed.terms, "part", packed.parts, m_step), "lda-weights")
        kept = written_table(state.where("part < 0"), "lda-gammas")  # the partial weights are added up now
        drop_table(state)
        state = kept
        bounds.append(float(bound))
        if len(bounds) > 1 and abs(bounds[-1] - bounds[-2]) < TOLERANCE * abs(bounds[-2]):
            break
        if k > 1:
            alpha = new_alpha(alpha, packed.n_docs, k, float(log_theta))
    own_weights = weights.where("block < 0").select("part", "data").join(packed.names, "part")
    model_terms = _unpacked(own_weights, "names", "term", "string", "weights", k)
    id_type = corp.schema["doc_id"].dataType.simpleString()
    if state is None:
        docs = spark.createDataFrame([], f"doc_id {id_type}, gamma array<double>")
    else:
        docs = _unpacked(state.where("part < 0").select("block", "data").join(packed.docs.select("block", "ids"), "block"),
                         "ids", "doc_id", id_type, "gamma", k)
    return Lda(k, model_terms, docs, alpha, bounds)


def _added(blobs: DataFrame, size: int) -> np.ndarray:
    """The sums of a few numbers a block."""
    return np.array(blobs.agg(*[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).first(), float)


def _unpacked(df: DataFrame, names: str, name: str, kind: str, numbers: str, k: int) -> DataFrame:
    """A row per entry of ``names`` with its k numbers of the matrix ``data``."""
    def rows(batches):
        for pdf in batches:
            for ids, data in zip(pdf[names], pdf["data"]):
                yield pd.DataFrame({name: list(ids), numbers: list(_matrix(data, k))})

    return df.select(names, "data").mapInPandas(rows, f"{name} {kind}, {numbers} array<double>")


def lda_topics(corp: DataFrame, k: int, max_iter: int = 20, seed: int = 1, n_terms: int = 5,
               block_entries: int = BLOCK_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, topic, prob)`` and ``(topic, terms)``.

    The topic is the most likely one (1-based, ties: the smaller); a document
    without any term gets null - the script's LDA rejects such documents.  The
    ``n_terms`` heaviest terms of a topic are joined by ``", "`` (two-stage
    top-k, no topic in one window)."""
    model = fit_lda(corp, k, max_iter, seed, block_entries=block_entries)
    best = F.array_max("gamma")
    topics = model.docs.select("doc_id", F.array_position("gamma", best).cast("int").alias("topic"),
                               (best / F.aggregate("gamma", F.lit(0.0), lambda s, x: s + x)).alias("prob"))
    doc_topics = corp.select("doc_id").join(topics, "doc_id", "left")
    long = model.terms.select("term", F.posexplode("weights").alias("t", "w")).select("term", (F.col("t") + 1).alias("topic"), "w")
    return doc_topics, concat_ranked(top_k_per_group(long, "topic", n_terms, "w"), "topic")
