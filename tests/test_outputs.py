"""Named outputs, the dense table without a pivot, the bound bag of words, tuning."""

import pytest
from pyspark.sql import functions as F

from newsfeat.operators import blend as bl
from newsfeat.operators import models as md
from newsfeat.operators import temporal as tm
from newsfeat.operators import textmining as tmx
from newsfeat.sources import csv as csvio


def test_named_outputs_come_back_with_their_manifest(spark, tmp_path):
    rows = [("a", 1, 0.5), ("a", 2, None), ("b x", 1, 0.25), ("Ü=1", 3, 1.0)]
    df = spark.createDataFrame(rows, "name string, UniqueID long, Probability1 double")
    for kind in ("csv", "parquet"):
        path = str(tmp_path / kind)
        csvio.write_named(df, path, kind)
        got = csvio.read_named(spark, path, csvio.SUBMISSION_SCHEMA, kind).select("name", "UniqueID", "Probability1").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))
        assert sorted(map(tuple, csvio.read_manifest(spark, path).collect())) == [("a", 2), ("b x", 1), ("Ü=1", 1)]
    with pytest.raises(ValueError):
        csvio.write_named(df.withColumn("name", F.lit(None).cast("string")), str(tmp_path / "none"))


def test_submissions_hold_models_and_blends(spark):
    stacked = spark.createDataFrame([("m", 1, 0.2), ("n", 1, 0.6), ("m", 2, 0.4)], "model string, UniqueID long, p double")
    got = {(r.name, r.UniqueID): r.Probability1 for r in bl.submissions(stacked, {"e": [("m", 1), ("n", 3)]}).collect()}
    assert got == {("mPred", 1): 0.2, ("nPred", 1): 0.6, ("mPred", 2): 0.4, ("ePred", 1): pytest.approx(0.5), ("ePred", 2): None}


def test_dense_table_of_many_levels(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, None), (None, "c")]
    df = spark.createDataFrame(rows, "r int, c string")
    got = sorted(map(tuple, tm.dense_counts(df, "r", "c").collect()))
    assert got == [(1, "a", 2), (1, "b", 1), (2, "a", 0), (2, "b", 1)]
    assert tm.dense_counts(df.limit(0), "r", "c").collect() == []
    many = spark.range(50_000).select((F.col("id") % 2).alias("r"), F.concat(F.lit("it's "), F.col("id").cast("string")).alias("c"))
    dense = tm.dense_counts(many, "r", "c")
    assert dense.agg(F.count("*"), F.sum("n"), F.max("n"), F.count_distinct("c")).first() == (100_000, 50_000, 1, 50_000)


def test_bound_columns_are_typed(spark):
    bow = spark.createDataFrame([(1, "Hword", 2)], "doc_id long, feature string, value long")
    frame = spark.createDataFrame([(1, "x", 5, None, 1.5), (2, None, 6, 1, None)], "UniqueID long, desk string, Hour int, Popular int, w double")
    got = sorted(map(str, map(tuple, tmx.bind_columns(bow, frame, ["desk", "Hour", "Popular", "w"], "UniqueID", {"Hour"}).collect())))
    assert got == sorted(map(str, [(1, "Hword", 2.0, None), (1, "desk", None, "x"), (1, "Hour", None, "5"), (1, "Popular", None, None),
                                   (1, "w", 1.5, None), (2, "desk", None, None), (2, "Hour", None, "6"), (2, "Popular", 1.0, None),
                                   (2, "w", None, None)]))


def test_tuning_equals_a_loop_over_folds(spark):
    df = spark.range(150).select(F.col("id").alias("UniqueID"), (F.col("id") % 7 > 3).cast("int").alias("Popular"),
                                 (F.col("id") % 7).cast("double").alias("x"), (F.col("id") * 37 % 11).cast("double").alias("y"),
                                 (F.col("id") % 5).cast("double").alias("z"))
    cols = ["x", "y", "z"]
    got = {r.mtry: r.accuracy for r in md.tune_forest(df, cols, num_trees=4, folds=3, seed=2, grid=[1, 3]).collect()}
    for mtry in (1, 3):
        right = []
        for fold in range(3):
            train = df.where(md.fold_of("UniqueID", 3, 2) != fold)
            pipeline, cats = md.random_forest_pipeline(train, cols, 4, seed=2)
            pipeline.getStages()[-1].setFeatureSubsetStrategy(str(mtry))
            scored = md.score(md.fit((pipeline, cats), train, cols), df.where(md.fold_of("UniqueID", 3, 2) == fold)).collect()
            right.append(sum((r.p > 0.5) == r.truth for r in scored) / len(scored))
        assert got[mtry] == pytest.approx(sum(right) / 3)
