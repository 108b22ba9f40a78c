"""SimHash against brute force: bits, links and components."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsfeat.llm import simhash
from newsfeat.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, prints, distance=2):
    """Smallest id reachable, by comparing all rows."""
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                label[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r)
    return [min((x for x in ids[find(i)] if x is not None), default=None) for i in range(len(rows))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["Ab", "cd", "É", "ef!", "GH", "ij", "kl", "mn"]
    out = [None, "", " \t\n", "one", "ONE", "one two", "a\x1cb\x85c d e f"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(40_000))
    out += [long, long + " tail", long.replace("Ab", "aB")]
    return out + out[10:30]


def test_fingerprints_and_components(spark, texts):
    ids = list(range(len(texts) - 3)) + [None, 7, 7]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in zip(ids, texts)], SCHEMA).withColumn(
        "fp", F.lit("clash")).withColumn("component_id", F.lit(-1)).withColumn("a", F.lit(0))
    got = simhash.simhash_components(df).collect()
    prints = [plain_fingerprint(t) for t in texts]
    want = sorted(zip([-1 if i is None else i for i in ids], prints, plain_components(ids, prints)))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64, r.component_id) for r in got)
    assert have == want


@pytest.mark.parametrize("sample, shard_rows, bound", [(300, 200, 65_536), (64, 100, 150), (16, 50, 60)])
def test_links_of_a_dense_cluster_span_all_pairs(spark, sample, shard_rows, bound):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63, 1, np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 5)).astype(np.uint64),
                                            initial=np.uint64(0)) for _ in range(1500)], np.uint64)
    other = rng.integers(0, 2**63, 1500, np.uint64)
    fps = np.unique(np.concatenate([centre ^ flips, other, other ^ np.uint64(3), other ^ np.uint64(1 << 60 | 7)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = simhash.fingerprint_links(df, sample=sample, shard_rows=shard_rows, bound=bound).cache()
    got = {r.node: r.root for r in connected_components(links).collect()}
    label = {int(x): int(x) for x in fps.view(np.int64)}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(fps.view(np.int64)[i])), find(int(fps.view(np.int64)[j]))
        label[max(a, b)] = min(a, b)
    want = {x: find(x) for x in label}
    assert {x: got.get(x, x) for x in want} == want
    rows = links.count()
    assert rows < 40 * len(fps)  # stars, not pairs


def test_large_shards_are_dealt_again(spark):
    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 2**63, 3000, np.uint64)).view(np.int64)
    dealt = spark.createDataFrame([("0", int(x)) for x in fps] + [("1", int(x)) for x in fps[:40]], "shard string, fp long")
    got = simhash.split_large(dealt, 1, 500, 200, 400).toPandas()
    sizes = got["shard"].value_counts()
    assert len(sizes) > 4 and sizes.max() < 1500 and set(got["fp"]) == set(fps.tolist())
    assert sizes["1"] == 40 and "0" not in sizes


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rows = [(3, "x y z", "en"), (1, "x Y z", "fr"), (1, "x Y z", "fr"), (2, "other words here", "en"),
            (5, None, "de"), (4, "", "de"), (None, "x y z", "en"), (None, "alone in its group", "en")]
    df = spark.createDataFrame([r + ("s", 1) for r in rows], SCHEMA)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [
        (0, "alone in its group"), (1, "x Y z"), (2, "other words here"), (4, "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(df).count() == 0
    assert simhash.near_dedup(df).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(-20, 50)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(None, 4), (9, 9)]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: -20 for i in range(-20, 51)}, **{1000 + i: 1000 for i in range(300)}}
