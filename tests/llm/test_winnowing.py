"""Winnowing against a plain model, its guarantee, and the neighbours' order."""

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from newsfeat.llm import winnowing as wi

SCHEMA = "doc_id long, text string, fp string, own string, edited string"


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def plain(text, k=wi.K, w=wi.W):
    """[(hash, position)] in text order."""
    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) % wi.PRIME for t in re.findall(r"[^ \t\n\r\f\v]{1,64}", (text or "").lower())]
    if not tokens:
        return []
    runs = [tokens[i:i + k] for i in range(max(1, len(tokens) - k + 1))]
    grams = []
    for run in runs:
        h = 0
        for t in run:
            h = (h * wi.BASE + t) % wi.PRIME
        grams.append(h)
    out = []
    for i in range(max(1, len(grams) - w + 1)):
        window = list(enumerate(grams[i:i + w], i))
        at, h = min(window, key=lambda x: (x[1], -x[0]))
        if (h, at) not in out[-1:]:
            out.append((h, at))
    return out


def corpus(n=120):
    rng = random.Random(9)
    words = ["Aa", "bb", "ccc", "d", "é", "F!", "gg"]
    return [" ".join(rng.choice(words) + str(rng.randint(0, 3)) for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 9, 40, 200]))) for _ in range(n)]


def test_same_as_plain_model(spark):
    texts = corpus() + [None, "", " \n ", "x" * 300, "same " * 5000]
    df = wi.winnow(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA), "text", "codes")
    for r in df.select("doc_id", wi.positions("codes").alias("p")).collect():
        want = plain(texts[r.doc_id])
        got = [(x["hash"], x["position"]) for x in r.p]
        assert [g for g in got] == want, texts[r.doc_id]


def test_common_runs_share_a_hash(spark):
    rng = random.Random(1)
    run = [f"w{rng.randint(0, 999)}" for _ in range(wi.K + wi.W - 1)]
    texts = [" ".join([f"a{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))] + run + [f"b{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))])
             for _ in range(40)]
    df = wi.winnow(spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA), "text", "codes")
    sets = [set(r.h) for r in df.select(wi.hashes("codes").alias("h")).collect()]
    assert all(a & b for a in sets for b in sets)


def check_edits(spark, rows):
    got = wi.fingerprint_edits(spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)).select(
        "doc_id", "n", "edited", wi.digest("fp").alias("d"), wi.digest("edited_fp").alias("e"),
        wi.likeness("own", "edited_own").alias("near"), wi.likeness("own", "next_own").alias("next")).collect()

    def key(r):
        return (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    order = sorted(rows, key=key)
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        a, b, c = ({h for h, _ in plain(t)} for t in (text, edited, after))
        want.append((doc_id, len(text), edited, round(len(a & b) / len(a | b), 9) if a | b else 1.0,
                     round(len(a & c) / len(a | c), 9) if a | c else 1.0))
    have = [(r.doc_id, r.n, r.edited, round(r.near, 9), round(r.next, 9)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        by_text.setdefault((r.edited, r.e), None)
    assert len({e for e, _ in by_text}) == len(by_text)


def test_edits_follow_descending_ids(spark):
    texts = corpus(300)
    ids = random.Random(2).sample(range(-50, 100_000), len(texts))
    check_edits(spark, list(zip(ids, texts)) + [(None, "null id one"), (None, None), (7_000_000_000, "Ünï ço\U0001f600 de " * 30),
                                                 (5, "twice"), (5, "twice"), (5, "other text")])


def test_ids_beyond_doubles_and_many_nulls(spark):
    texts = corpus(260)
    ids = [2**60 + i for i in range(40)] + [2**63 - 1 - i for i in range(40)] + [-2**63 + i for i in range(40)]
    ids += list(range(-20, 20)) + [None] * 100
    random.Random(4).shuffle(ids)
    check_edits(spark, [(i, f"{t} own{k}") for k, (i, t) in enumerate(zip(ids, texts))])


def test_null_ids_are_spread(spark):
    rows = [(None, f"text {i} of many without an id", "", "", "") for i in range(3000)] + [(1, "one", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").repartition(8)
    seen = wi.with_next(df, "doc_id", F.xxhash64("text"), {"ahead": F.col("text")}, [
        lambda d: d.withColumn("block", F.col("__block"))])
    blocks = [r["count"] for r in seen.groupBy("block").count().collect()]
    assert len(blocks) > 20 and max(blocks) < 600


def test_few_rows(spark):
    check_edits(spark, [(1, "a b c d e f g h i j k l m n o p")])
    check_edits(spark, [(1, None), (2, "a b c d e f")])
    assert wi.fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_texts_have_equal_digests(spark):
    df = wi.winnow(spark.createDataFrame([(i, "some words in a row here now", "", "", "") for i in range(3)], SCHEMA), "text", "codes")
    assert df.select(wi.digest("codes")).distinct().count() == 1
    assert hashlib.sha256(b"").hexdigest() == wi.winnow(
        spark.createDataFrame([(1, None, "", "", "")], SCHEMA), "text", "codes").select(wi.digest("codes")).first()[0]


def test_arrays_are_not_evaluated_inside_lambdas(spark):
    df = wi.winnow(spark.createDataFrame([(1, "a b", "", "", "")], SCHEMA), "text", "codes").select("codes")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("transform(") <= 4
    assert F is not None
