import math

from pyspark.sql import functions as F

from newsfeat.functions.stem import stem
from newsfeat.operators import textmining as tmx


def test_sparse_threshold_strict(spark):
    # N = 100, sparse = 0.99: df = 1 dropped, df = 2 kept.
    dfreq = spark.createDataFrame([("a", 1), ("b", 2)], "term string, df long")
    kept = [r["term"] for r in tmx.keep_dense_terms(dfreq, 100, 0.99).collect()]
    assert kept == ["b"]


def test_ngrams_and_short_terms(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat.")], "doc_id long, text string")
    corp = tmx.corpus(df, "doc_id", "text", ["the"], 1, 3)
    terms = corp.first()["terms"]
    assert terms == ["cat", "sat", "mat", "cat sat", "sat on", "on mat", "cat sat on", "sat on mat"]


def test_stopwords_after_punctuation(spark):
    df = spark.createDataFrame([(1, "don't stop")], "doc_id long, text string")
    toks = df.select(tmx.clean_tokens(F.col("text"), ["don't", "dont"]).alias("t")).first()["t"]
    assert toks == ["stop"]


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma")], "doc_id long, text string")
    tc = tmx.term_counts(tmx.corpus(df, "doc_id", "text"))
    w = {(r["doc_id"], r["term"]): r["weight"] for r in tmx.tfidf(tc, 2).collect()}
    assert w[(1, "alpha")] == 0.0
    assert math.isclose(w[(1, "beta")], 2 / 3 * math.log2(2))
    assert math.isclose(w[(2, "gamma")], 1 / 2 * math.log2(2))


def test_stemmer_published_examples():
    for word, expected in [("consignment", "consign"), ("generously", "generous"), ("ponies", "poni"),
                           ("hopping", "hop"), ("relational", "relat"), ("skies", "sky"), ("succeeding", "succeed")]:
        assert stem(word) == expected


def test_stem_udf(spark):
    from newsfeat.functions.stem import stemmer
    df = spark.createDataFrame([(["running", "cats"],)], "tokens array<string>")
    assert stemmer(df, "tokens").first()["tokens"] == ["run", "cat"]


def test_two_stage_top_k_equals_single_window(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(3)
    rows = [(g, f"t{i}", rnd.randint(0, 20)) for g in ("a", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "g string, term string, freq long")
    got = {(r["g"], r["rank"], r["term"]) for r in tmx.top_k_per_group(df, "g", 7, "freq", buckets=5).collect()}
    w = Window.partitionBy("g").orderBy(F.desc("freq"), F.asc("term"))
    want = {(r["g"], r["rank"], r["term"]) for r in
            df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 7).collect()}
    assert got == want


def test_global_rank_matches_sorted_order(spark):
    import random
    rnd = random.Random(5)
    rows = [(f"t{i:04d}", rnd.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "term string, freq long")
    got = {r["term"]: r["bar_order"] for r in tmx.ordered_bars(df).collect()}
    want = {t: i + 1 for i, (t, _) in enumerate(sorted(rows, key=lambda x: (x[1], x[0])))}
    assert got == want


def test_stems_of_batches_with_nulls(spark):
    """Arrays over several Arrow batches against the stemmer itself, token by token."""
    from newsfeat.functions import stem as st
    words = ["running", "runs", "news", "", None, "generalization", "é", "skies", "y"]
    rows = [(i, None if i % 11 == 3 else [words[(i * 7 + j) % len(words)] for j in range(i % 6)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, toks array<string>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {r.id: r.toks for r in st.stemmer(df, "toks").collect()}
        single = {r.token: r.stem for r in st.stem_vocabulary(F.col("toks"), df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: None if t is None else [st.stem(w) for w in t] for i, t in rows}
    assert single == {w: st.stem(w) for w in words if w is not None}


def _repeated_tokens(spark, repeat):
    import random
    rnd = random.Random(3)
    words = ["a", "bb", "ccc", "dddd", "é", "ooo"] + [f"w{i}" for i in range(60)]
    rows = [(i % 20 if repeat and i % 9 else (None if i == 0 else i),
             None if i == 7 else [rnd.choice(words[:6] if rnd.random() < 0.8 else words) for _ in range(rnd.randint(0, 25))])
            for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(3)


def _plain_counts(rows, n_min, n_max):
    """``{(doc_id, term): (tf, largest total of a row with it)}`` and document counts."""
    from collections import Counter
    found, df = {}, Counter()
    for d, toks in rows:
        grams = [" ".join(toks[i:i + n]) for n in range(n_min, n_max + 1) for i in range(len(toks or []) - n + 1)]
        grams = [g for g in grams if len(g) >= 3]
        df.update(set(grams))
        for t, c in Counter(grams).items():
            tf, total = found.get((d, t), (0, 0))
            found[d, t] = (tf + c, max(total, len(grams)))
    return found, df


def test_dense_counts_equal_all_counts_after_the_cut(spark, monkeypatch):
    from newsfeat.operators import grams
    for repeat, step in ((False, 500_000), (True, 7)):
        monkeypatch.setattr(grams, "STEP_TOKENS", step)
        rows, toks = _repeated_tokens(spark, repeat)
        for sparse, n_min, n_max in ((0.9, 1, 3), (0.95, 2, 3), (0.7, 1, 1)):
            found, df = _plain_counts(rows, n_min, n_max)
            want = {(d, t): (*v, df[t]) for (d, t), v in found.items() if df[t] > 40 * (1.0 - sparse)}
            got = {(r.doc_id, r.term): (r.tf, r.doc_total, r.df) for r in tmx.remove_sparse_terms(toks, 40, sparse, n_min, n_max).collect()}
            assert got == want and want


def test_terms_below_the_cut_are_not_shuffled(spark):
    """No plan of the dense counts forms n-grams as text."""
    _, toks = _repeated_tokens(spark, False)
    plan = tmx.remove_sparse_terms(toks, 40, 0.9, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "zip_with" not in plan


def test_term_counts_within_rows(spark):
    for repeat in (False, True):
        rows, toks = _repeated_tokens(spark, repeat)
        out = tmx.term_counts(tmx.terms_of(toks, 1, 3))
        assert {(r.doc_id, r.term): (r.tf, r.doc_total) for r in out.collect()} == _plain_counts(rows, 1, 3)[0]
        shuffled = out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
        assert shuffled == int(repeat)
