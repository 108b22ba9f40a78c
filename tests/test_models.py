import itertools

import numpy as np
from pyspark.sql import functions as F

from newsfeat.operators import models as md
from newsfeat.operators import topics as tp
from tests.conftest import SF_SMALL


def small_frame(spark, n=200):
    rows = [(i, (i * 7) % 3 == 0 and 1 or 0, float(i % 10), ["a", "b", "c"][i % 3], i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "UniqueID long, Popular int, x double, NewsDesk string, const int")
    return df.withColumn("const", F.lit(1))


def test_forest_probabilities_in_range_and_seeded(spark):
    df = small_frame(spark)
    cols = ["x", "NewsDesk", "const"]
    a = md.score(md.fit(md.random_forest_pipeline(df, cols, num_trees=10, seed=3), df, cols), df)
    b = md.score(md.fit(md.random_forest_pipeline(df, cols, num_trees=10, seed=3), df, cols), df)
    pa = {r["UniqueID"]: r["p"] for r in a.collect()}
    pb = {r["UniqueID"]: r["p"] for r in b.collect()}
    assert pa == pb
    assert all(0.0 <= p <= 1.0 for p in pa.values())


def test_permutation_importance_of_constant_is_zero(spark):
    df = small_frame(spark)
    cols = ["x", "NewsDesk", "const"]
    folds = md.crossfit(lambda d, c: md.random_forest_pipeline(d, c, num_trees=10, seed=3), df, cols, 3)
    imp = {r["feature"]: r["importance"] for r in md.permutation_importance(folds, seed=5).collect()}
    assert imp["const"] == 0.0 and set(imp) == set(cols)
    assert md.crossfit_predictions(folds).count() == df.count()


def test_permutation_drop_of_a_known_score(spark):
    """A model that reads one feature: the drop is that of an arithmetic permutation."""
    df = spark.range(400).select(F.col("id").alias("UniqueID"), (F.col("id") % 2).cast("int").alias("Popular"),
                                 (F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("y"))
    folds = md.crossfit(lambda d, c: md.random_forest_pipeline(d, c, num_trees=5, seed=3), df, ["x", "y"], 2)
    want = 0
    for held, _ in folds:
        moved = md.with_partner(held, ["x"], 5).select("x", F.col("__other.x").alias("other"))
        want += moved.where("x <> other").count()
    imp = {r["feature"]: r["importance"] for r in md.permutation_importance(folds, seed=5).collect()}
    assert abs(imp["x"] - want / 400) < 1e-9 and imp["y"] == 0.0


def test_partner_is_a_permutation(spark):
    df = small_frame(spark, 50)
    out = md.with_partner(df, ["x", "UniqueID"], seed=9).collect()
    assert sorted(r["__other"]["UniqueID"] for r in out) == list(range(50))
    assert all(r["__other"]["UniqueID"] != r["UniqueID"] for r in out)


def test_blocks_of_ids_with_a_far_one(spark):
    df = spark.range(3000).select(F.col("id").alias("UniqueID"), F.lit(1).alias("Popular")).unionByName(
        spark.createDataFrame([(10**15, 1)], "UniqueID long, Popular int"))
    ranked = md.hash_rank(df, "Popular", seed=None, rows_per_block=100)
    got = {r["UniqueID"]: r["__rank"] for r in ranked.collect()}
    assert got == {**{i: i + 1 for i in range(3000)}, 10**15: 3001}


def test_stratified_partition_sizes(spark):
    df = small_frame(spark, 101)
    for seed in (None, 4):
        out = md.stratified_partition(df, 0.5, seed=seed)
        got = {r["Popular"]: r["k"] for r in out.groupBy("Popular").agg(F.sum("in_first").alias("k")).collect()}
        n = {r["Popular"]: r["count"] for r in df.groupBy("Popular").count().collect()}
        assert all(got[k] == -(-n[k] // 2) for k in n)


def test_hash_rank_blocks_give_dense_ranks(spark):
    df = small_frame(spark, 120)
    ranked = md.hash_rank(df, "Popular", seed=2, rows_per_block=10)
    for lab in (0, 1):
        ranks = sorted(r["__rank"] for r in ranked.where(F.col("Popular") == lab).collect())
        assert ranks == list(range(1, len(ranks) + 1))


def test_logistic_probabilities(spark):
    df = small_frame(spark)
    cols = ["x", "NewsDesk"]
    s = md.score(md.fit(md.logistic_pipeline(df, cols), df, cols), df)
    assert all(0.0 <= r["p"] <= 1.0 for r in s.collect())


def test_kmeans_assigns_every_document_once(spark):
    rows = [(d, t, 1.0) for d in range(30) for t in (["a", "b"] if d < 15 else ["c", "d"])]
    pts = spark.createDataFrame(rows, "doc_id long, term string, w double")
    docs = spark.createDataFrame([(d,) for d in range(32)], "doc_id long")
    assign, _ = tp.kmeans(pts, 2, 5, seed=1, docs=docs)
    got = {r["doc_id"]: r["cluster"] for r in assign.collect()}
    assert len(got) == 32 and set(got.values()) <= {0, 1}
    assert len({got[d] for d in range(15)}) == 1 and len({got[d] for d in range(15, 30)}) == 1
    assert got[0] != got[20]


def within(points, labels):
    return sum(((points[labels == c] - points[labels == c].mean(0)) ** 2).sum() for c in np.unique(labels))


def test_transfers_never_cost_and_leave_no_single_move(spark):
    """Against a plain loop over all points and clusters, from bad and from Lloyd's ends."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        points = np.round(rng.normal(size=(60, 3)) + rng.integers(0, 3, (60, 1)), 3)
        begin = rng.integers(0, 4, 60)
        if seed:  # plain Lloyd to its end
            for _ in range(100):
                means = np.stack([points[begin == c].mean(0) if (begin == c).any() else points[c] for c in range(4)])
                begin = ((points[:, None] - means) ** 2).sum(2).argmin(1)
        state = spark.createDataFrame([(d, [0, 1, 2], points[d].tolist(), int(begin[d])) for d in range(60)],
                                      "doc_id long, i array<int>, w array<double>, cluster int")
        got, means, cost = tp.transfer(state, 4, 3, passes=40, seed=seed)
        labels = np.array([r.cluster for r in sorted(got.collect())])
        assert abs(cost - within(points, labels)) < 1e-6 and cost <= within(points, begin) + 1e-9
        assert np.allclose(means[labels], np.stack([points[labels == c].mean(0) for c in labels]))
        for d in range(60):
            for c in range(4):
                other = labels.copy()
                other[d] = c
                assert within(points, other) >= cost - 1e-6


def test_transfers_beat_a_stuck_lloyd(spark):
    """3 is nearer to the mean of {0, 0, 3} than to 6, so Lloyd stays there; moving it to the lone point saves."""
    points = [0.0, 0.0, 3.0, 6.0]
    state = spark.createDataFrame([(d, [0], [x], int(d == 3)) for d, x in enumerate(points)],
                                  "doc_id long, i array<int>, w array<double>, cluster int")
    got, _, cost = tp.transfer(state, 2, 1)
    assert cost < within(np.array(points)[:, None], np.array([0, 0, 0, 1]))
    assert cost == min(within(np.array(points)[:, None], np.array(x)) for x in itertools.product((0, 1), repeat=4))
    assert len({r.cluster for r in got.collect()}) == 2


def test_kmeans_starts_keep_the_least_cost(spark):
    rows = [(d, f"t{d % 5}", 1.0 + d % 3) for d in range(40)]
    pts = spark.createDataFrame(rows, "doc_id long, term string, w double")
    dense = np.zeros((40, 5))
    for d, t, w in rows:
        dense[d, int(t[1:])] = w

    def cost(starts):
        labels = {r.doc_id: r.cluster for r in tp.kmeans(pts, 3, 2, seed=1, starts=starts)[0].collect()}
        return within(dense, np.array([labels[d] for d in range(40)]))
    assert cost(3) <= cost(1) + 1e-9


def test_kmeans_beats_chance_on_embeddings(spark):
    from newsfeat.sources import tables
    e = tables.embeddings(spark, SF_SMALL)
    long = e.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("dim", "x")).select(
        "doc_id", F.col("dim").cast("string").alias("term"), F.col("x").cast("double").alias("w"))
    k = e.select("label").distinct().count()
    assign, _ = tp.kmeans(long, k, 10, seed=1)
    j = assign.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    purity = (j.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max("count").alias("m"))
               .agg(F.sum("m")).first()[0]) / j.count()
    majority = e.groupBy("label").count().agg(F.max("count")).first()[0] / e.count()
    assert purity >= majority


def test_bisecting_separates_blocks(spark):
    rows = [(f"t{i}", f"d{j}", 1.0) for i in range(20) for j in (range(0, 5) if i < 10 else range(5, 10))]
    pts = spark.createDataFrame(rows, "id string, feature string, w double")
    tree = {r["id"]: r["path"] for r in tp.bisecting_kmeans(pts, 2, iters=3, seed=1).collect()}
    assert len(tree) == 20 and all(len(p) == 2 for p in tree.values())
    first = {i: tree[f"t{i}"][0] for i in range(20)}
    assert len({first[i] for i in range(10)}) == 1 and len({first[i] for i in range(10, 20)}) == 1
    assert first[0] != first[15]


def test_bisecting_ends_at_equal_rows(spark):
    import random
    rng = random.Random(5)
    rows = [(f"t{i}", f"d{j}", float(2 ** rng.randint(0, 3))) for i in range(24) for j in rng.sample(range(8), 3)]
    rows += [(f"u{i}", f, w) for i in range(6) for t, f, w in rows if t == f"t{i}"] + [("z", "d0", 0.0)]
    pts = spark.createDataFrame(rows, "id string, feature string, w double")
    profile = {}
    for t, f, w in rows:
        profile.setdefault(t, set()).update({(f, w)} if w else set())
    trees = [{r["id"]: r["path"] for r in tp.bisecting_kmeans(pts, iters=2, local_rows=n).collect()} for n in (4096, 16)]
    for tree in trees:
        assert set(tree) == set(profile) and max(map(len, tree.values())) > 4
        by_path = {}
        for t, p in tree.items():
            by_path.setdefault(p, set()).add(frozenset(profile[t]))
        assert all(len(x) == 1 for x in by_path.values())
        assert len(by_path) == len({frozenset(x) for x in profile.values()})
        assert not any(a != b and b.startswith(a) for a in by_path for b in by_path)


def test_column_scaling_matches_dense_standardisation(spark):
    import math
    rows = [("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 2.0)]
    pts = spark.createDataFrame(rows, "id string, feature string, w double")
    got = {(r["id"], r["feature"]): r["w"] for r in tp.column_scaled(pts, 3).collect()}
    sd_x = math.sqrt(((1 - 4 / 3) ** 2 + (3 - 4 / 3) ** 2 + (0 - 4 / 3) ** 2) / 2)
    assert math.isclose(got[("a", "x")], 1.0 / sd_x) and math.isclose(got[("b", "x")], 3.0 / sd_x)


def test_popularity_pipeline_end_to_end(spark, tmp_path):
    from newsfeat.functions import fixed
    from newsfeat.plans.pipeline import popularity_pipeline
    from newsfeat.sources import fixtures as fx
    arts = fx.articles(spark, SF_SMALL)
    out = popularity_pipeline(arts, str(tmp_path), stopwords=fx.FIXTURE_STOPWORDS, num_trees=10, kmeans_iter=3,
                              rule_kwargs={"headline_prefixes": fx.FIXTURE_POLITICS_PREFIXES})
    n_test = arts.where(F.col("Popular").isNull()).count()
    preds = [k for k in out if k.endswith("Pred")]
    assert len(preds) == 6 + len(fixed.BLENDS) == 13
    for k in preds:
        rows = out[k].collect()
        assert len(rows) == n_test and all(0.0 <= r["Probability1"] <= 1.0 for r in rows)
    back = spark.read.option("header", "true").csv(str(tmp_path / "Submission_ens2Sel3BoW1LogPred"))
    assert back.count() == n_test
    manifest = {r.name: r.rows for r in spark.read.json(str(tmp_path / "charts" / "_manifest")).collect()}
    assert set(manifest) <= {"logwc", "logwc_weekday", "headline_chars", "headline_words", "daily_articles", "daily_section",
                             "hourly", "headline_terms", "text_terms", "topics_over_time", "importance"}
    assert {"logwc", "importance", "topics_over_time"} <= set(manifest) and min(manifest.values()) > 0
