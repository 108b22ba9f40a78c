import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from newsfeat.functions import fixed
from newsfeat.operators import blend as bl
from newsfeat.operators import evaluate as ev


def brute_auc(rows):
    pos = [s for t, s in rows if t == 1]
    neg = [s for t, s in rows if t == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_all_ties_is_half(spark):
    df = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "truth int, score double")
    assert ev.auc(df).first()["auc"] == 0.5


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_auc_matches_brute_force(spark, buckets):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(rows, "truth int, score double")
    assert math.isclose(ev.auc(df, buckets=buckets).first()["auc"], brute_auc(rows), rel_tol=1e-12)


def test_accuracy_and_confusion(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)], "truth int, score double")
    assert ev.accuracy(df).first()["accuracy"] == 0.5
    got = {(r["truth"], r["predicted"]): r["n"] for r in ev.confusion(df).collect()}
    assert got == {(1, 1): 1, (0, 0): 1, (1, 0): 1, (0, 1): 1}


def test_blend_between_min_and_max(spark):
    rows = [("a", 1, 0.2), ("b", 1, 0.8), ("c", 1, 0.5), ("a", 2, 0.1), ("b", 2, 0.3), ("c", 2, 0.9)]
    stacked = spark.createDataFrame(rows, "model string, UniqueID long, p double")
    out = {r["UniqueID"]: r["Probability1"] for r in bl.blend(stacked, [("a", 2), ("b", 3), ("c", 1)]).collect()}
    assert math.isclose(out[1], (2 * 0.2 + 3 * 0.8 + 0.5) / 6)
    assert 0.1 <= out[2] <= 0.9


def test_blend_as_written_uses_lda_twice():
    w = bl._merge_weights(fixed.BLEND_AS_WRITTEN["ens3KMC2LDA4BoW1Log_as_written"])
    assert w == {"rfCustomSelLDA": 5.0, "rfBoW": 4.0, "log": 1.0}


def test_blend_missing_model_gives_null(spark):
    stacked = spark.createDataFrame([("a", 1, 0.2)], "model string, UniqueID long, p double")
    assert bl.blend(stacked, {"a": 1, "b": 1}).first()["Probability1"] is None


def test_exact_quantiles_match_percentile(spark):
    from newsfeat.operators.charts import exact_quantiles
    rnd = random.Random(11)
    rows = [(g, float(rnd.randint(0, 30))) for g in ("a", "b") for _ in range(rnd.randint(5, 200))]
    rows.append(("c", 4.0))
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: (r["q1"], r["q3"]) for r in exact_quantiles(df, ["g"], "x", {"q1": 0.25, "q3": 0.75}, 3).collect()}
    want = {r["g"]: (r["q1"], r["q3"]) for r in df.groupBy("g").agg(
        F.percentile("x", F.lit(0.25)).alias("q1"), F.percentile("x", F.lit(0.75)).alias("q3")).collect()}
    assert got.keys() == want.keys()
    for g in got:
        assert math.isclose(got[g][0], want[g][0]) and math.isclose(got[g][1], want[g][1])
