"""Ranks, quantiles, blends, readers and encodings that once depended on size or order."""

import pytest
from pyspark.sql import functions as F

from newsfeat.operators import blend as bl
from newsfeat.operators import charts
from newsfeat.operators import models as md
from newsfeat.operators import textmining as tmx
from newsfeat.sources import csv as csvio


@pytest.mark.parametrize("ranges", [8, 16])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_ranks_are_dense_with_extra_columns(spark, ranges, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 200_000
        df = spark.range(n).select((F.xxhash64("id") % 1000).alias("v"), F.col("id").alias("label"),
                                   F.rand(3).alias("x"), F.lit("wide").alias("y"))
        r = tmx.global_rank(df, ["v", "label"], "r", ranges).agg(
            F.count_distinct("r").alias("d"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
        assert (r.d, r.lo, r.hi) == (n, 1, n)
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_quantiles_equal_percentile(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 10_000_000).cast("double").alias("x"),
                                         F.lit("wide").alias("y"))
        got = {r.g: (r.q1, r.q3) for r in charts.exact_quantiles(df, ["g"], "x", {"q1": 0.25, "q3": 0.75}, 16).collect()}
        want = {r.g: (r.q1, r.q3) for r in df.groupBy("g").agg(F.expr("percentile(x, 0.25)").alias("q1"),
                                                               F.expr("percentile(x, 0.75)").alias("q3")).collect()}
        assert got == want
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_null_prediction_gives_null_blend(spark):
    rows = [("a", 1, 0.9), ("b", 1, None), ("a", 2, 0.5), ("b", 2, 0.1), ("a", 3, 0.4)]
    stacked = spark.createDataFrame(rows, "model string, UniqueID long, p double")
    want = {1: None, 2: pytest.approx(0.3), 3: None}
    assert {r.UniqueID: r.Probability1 for r in bl.blend(stacked, {"a": 1, "b": 1}).collect()} == want
    assert {r.UniqueID: r.Probability1 for r in bl.all_blends(stacked, {"e": {"a": 1, "b": 1}}).collect()} == want


def test_density_of_nothing(spark):
    df = spark.createDataFrame([], "x double, g string, f string")
    out = charts.scaled_density(df, "x", "g", "f")
    assert out.columns == ["f", "g", "i", "x", "density", "scaled"] and out.count() == 0


def test_csv_columns_go_by_name(spark, tmp_path):
    names = [f.name for f in csvio.ARTICLE_CSV_SCHEMA.fields]
    values = {n: f"{n}-value" for n in names} | {"WordCount": "7", "PubDate": "2014-09-01 10:00:00", "Popular": "1", "UniqueID": "3"}
    swapped = names[::-1]
    (tmp_path / "a.csv").write_text(",".join(swapped) + "\n" + ",".join(values[n] for n in swapped) + "\n")
    row = csvio.read_articles_csv(spark, str(tmp_path / "a.csv")).first()
    assert (row.NewsDesk, row.SectionName, row.WordCount, row.UniqueID) == ("NewsDesk-value", "SectionName-value", 7, 3)


def test_treatment_coding_drops_the_first_level(spark):
    rows = [(c, float(i % 7), int((i * 7 + ord(c)) % 3 == 0)) for i in range(60) for c in "abc"]
    df = spark.createDataFrame(rows, "NewsDesk string, x double, Popular int")
    pipeline, _ = md.logistic_pipeline(df, ["NewsDesk", "x"])
    fitted = md.fit((pipeline, ["NewsDesk"]), df, ["NewsDesk", "x"])
    prepared = md._prepared(spark.createDataFrame([("a", 1.0, 0), ("b", 1.0, 0), ("c", 1.0, 0), ("new", 1.0, 0)], df.schema),
                            ["NewsDesk", "x"], ["NewsDesk"], "Popular")
    features = [tuple(r.features.toArray()) for r in fitted.model.transform(prepared).collect()]
    assert sorted(features[1:3]) == [(0.0, 1.0, 1.0), (1.0, 0.0, 1.0)]
    assert features[0] == features[3] == (0.0, 0.0, 1.0)


def test_bins_follow_the_levels(spark):
    df = spark.range(400).select((F.col("id") % 150).cast("string").alias("NewsDesk"), F.col("id").cast("double").alias("x"),
                                 (F.col("id") % 2).cast("int").alias("Popular"))
    fitted = md.fit(md.random_forest_pipeline(df, ["NewsDesk", "x"], num_trees=3), df, ["NewsDesk", "x"])
    assert fitted.model.stages[-1].getOrDefault("maxBins") >= 152
