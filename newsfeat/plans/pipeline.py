"""End-to-end plans.

``article_features`` is the script's first half (clean -> fill categories ->
features -> temporal counts) as one lazy plan: narrow projections, one small
aggregate, one join.  ``popularity_pipeline`` continues with text features,
topics, models, scores, blends and submissions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsfeat.functions import fixed
from newsfeat.operators import features as ft
from newsfeat.operators import rules
from newsfeat.operators import temporal as tm


def cleaned_and_filled(articles: DataFrame, phrases=fixed.PHRASES, rule_kwargs: dict | None = None) -> DataFrame:
    df = ft.clean_articles(articles, phrases)
    return rules.fill_categories(df, **(rule_kwargs or {}))


def article_features(articles: DataFrame, flags=None, phrases=fixed.PHRASES,
                     rule_kwargs: dict | None = None, counts: bool = True) -> DataFrame:
    df = ft.add_features(cleaned_and_filled(articles, phrases, rule_kwargs), flags)
    return tm.with_temporal_counts(df) if counts else df


# Density charts: name -> (value, group, facet, labelled articles only).
DENSITY_CHARTS = {
    "logwc": ("LogWC", "Popular", None, True),
    "logwc_weekday": ("LogWC", "Popular", "DayOfWeek", True),
    "headline_chars": ("HeadlineCharCount", "Popular", None, True),
    "headline_words": ("HeadlineWordCount", "Popular", None, True),
    "daily_articles": ("NumDailyArticles", "Pop", None, False),
    "daily_section": ("NumDailySectionArticles", "Popular", "SectionName", True),
    "hourly": ("NumHourlyArticles", "Popular", "Hour", True),
}
CHART_SCHEMA = "facet string, series string, i int, x double, y double"


def chart_series(feats: DataFrame, bars: dict[str, DataFrame], more: dict[str, DataFrame] | None = None) -> DataFrame:
    """All chart data in one table ``(name, facet, series, i, x, y)``: scaled
    densities of the article features, ordered bars ``(term, freq, bar_order)``
    and other tables that have these columns already."""
    from functools import reduce

    from pyspark.sql import functions as F

    from newsfeat.operators import charts
    none = F.lit(None)
    parts = []
    for name, (x, group, facet, labelled) in DENSITY_CHARTS.items():
        d = charts.scaled_density(feats.where("Popular IS NOT NULL") if labelled else feats, x, group, facet)
        parts.append(d.select(F.lit(name).alias("name"), (F.col(facet) if facet else none).cast("string").alias("facet"),
                              F.col(group).cast("string").alias("series"), F.col("i").cast("int").alias("i"), "x",
                              F.col("scaled").alias("y")))
    for name, b in bars.items():
        parts.append(b.select(F.lit(name).alias("name"), none.cast("string").alias("facet"), F.col("term").alias("series"),
                              F.col("bar_order").cast("int").alias("i"), none.cast("double").alias("x"),
                              F.col("freq").cast("double").alias("y")))
    parts += [df.select(F.lit(name).alias("name"), "facet", "series", "i", "x", "y") for name, df in (more or {}).items()]
    return reduce(DataFrame.unionByName, parts)


def popularity_pipeline(articles: DataFrame, out_dir: str | None = None, *, flags=None,
                        phrases=fixed.PHRASES, rule_kwargs: dict | None = None, stopwords=None,
                        num_trees: int = fixed.RF_TREES, seed: int = 1, kmeans_iter: int = 10,
                        blends: dict = fixed.BLENDS) -> dict[str, DataFrame]:
    """The whole script as Spark jobs, from the article table to submissions.

    ``articles`` has the source schema (``UniqueID, NewsDesk, SectionName,
    SubsectionName, Headline, Snippet, Abstract, WordCount, PubDate, Popular``;
    ``Popular`` null = to be scored).  Returns the intermediate tables and one
    ``(UniqueID, Probability1)`` table per model and blend; with ``out_dir`` each
    of those is also written as ``Submission_<name>`` CSV.  Tables with several
    consumers are written once to the shared checkpoint folder.
    """
    from pyspark.ml.feature import CountVectorizer
    from pyspark.sql import functions as F

    from newsfeat.functions.stem import stemmer
    from newsfeat.operators import blend as bl
    from newsfeat.operators import lda
    from newsfeat.operators import models as md
    from newsfeat.operators import textmining as tmx
    from newsfeat.operators import topics as tp
    from newsfeat.session import cut_lineage, written_table
    from newsfeat.sources import csv as csvio

    feats = cut_lineage(article_features(articles, flags, phrases, rule_kwargs))
    frame = ft.model_frame(feats)

    # Topics from the stemmed text corpus: n-gram TF-IDF k-means and unigram LDA.
    text_tokens = written_table(tmx.corpus_tokens(feats, "UniqueID", "Text", stopwords, stemmer), "tokens")
    n_docs = tmx.n_docs(text_tokens)
    w = tmx.dense_tfidf(text_tokens, n_docs, fixed.SPARSITY_TEXT, fixed.NGRAM_MIN, fixed.NGRAM_MAX)
    docs = feats.select(F.col("UniqueID").alias("doc_id"))
    assign, _ = tp.kmeans(w.select("doc_id", "term", F.col("weight").alias("w")), fixed.N_CLUSTERS,
                          kmeans_iter, seed, docs)
    unigrams = tmx.terms_of(text_tokens)
    doc_topics, topic_terms = lda.lda_topics(unigrams, fixed.N_TOPICS, seed=seed, n_terms=fixed.TOP_TERMS_PER_TOPIC)
    frame = cut_lineage(
        frame.join(assign.select(F.col("doc_id").alias("UniqueID"), F.col("cluster").alias("TopicCluster")),
                   "UniqueID", "left")
             .join(doc_topics.select(F.col("doc_id").alias("UniqueID"), F.col("topic").alias("Topic")),
                   "UniqueID", "left"))

    test = frame.where(F.col("Popular").isNull())
    not_features = ["DayOfWeekOrder"]
    full_ex = fixed.RF_FULL_EXCLUDE + not_features
    sel_ex = full_ex + fixed.RF_SELECTED_EXTRA_EXCLUDE

    def forest(exclude):
        cols = md.feature_columns(frame, [c for c in exclude if c in frame.columns])
        fitted = md.fit(md.random_forest_pipeline(frame, cols, num_trees=num_trees, seed=seed), frame, cols)
        return md.score(fitted, test).select("UniqueID", "p")

    preds = {
        "rfCustomFull": forest(full_ex),
        "rfCustomSel": forest(sel_ex),
        "rfCustomSelKMC": forest([c for c in sel_ex if c != "TopicCluster"]),
        "rfCustomSelLDA": forest([c for c in sel_ex if c != "Topic"]),
    }
    log_fit = md.fit(md.logistic_pipeline(frame, fixed.LOGISTIC_PREDICTORS), frame, fixed.LOGISTIC_PREDICTORS)
    preds["log"] = md.score(log_fit, test).select("UniqueID", "p")

    # Bag-of-words forest: stemmed headline / summary term vectors (sparsity cut
    # as minimum document frequency) plus the metadata columns.
    h = tmx.corpus(feats, "UniqueID", "Headline", stopwords, 1, 1, stemmer).withColumnRenamed("terms", "hterms")
    s = tmx.corpus(feats, "UniqueID", "Summary", stopwords, 1, 1, stemmer).withColumnRenamed("terms", "sterms")
    bow = cut_lineage(frame.select("UniqueID", *fixed.BOW_EXTRA_COLUMNS)
                      .join(h.withColumnRenamed("doc_id", "UniqueID"), "UniqueID")
                      .join(s.withColumnRenamed("doc_id", "UniqueID"), "UniqueID"))
    cap = tp.NO_VOCAB_CAP
    min_h = int(tmx.sparse_threshold(n_docs, fixed.SPARSITY_HEADLINE)) + 1
    min_s = int(tmx.sparse_threshold(n_docs, fixed.SPARSITY_SUMMARY)) + 1
    bow = CountVectorizer(inputCol="hterms", outputCol="H", minDF=float(min_h), vocabSize=cap).fit(bow).transform(bow)
    bow = CountVectorizer(inputCol="sterms", outputCol="S", minDF=float(min_s), vocabSize=cap).fit(bow).transform(bow)
    bow = cut_lineage(bow.drop("hterms", "sterms"))
    bow_cols = ["H", "S"] + [c for c in fixed.BOW_EXTRA_COLUMNS if c != "Popular"]
    bow_fit = md.fit(md.random_forest_pipeline(bow, bow_cols, num_trees=num_trees, seed=seed), bow, bow_cols)
    preds["rfBoW"] = md.score(bow_fit, bow.where(F.col("Popular").isNull())).select("UniqueID", "p")

    preds = {k: cut_lineage(v) for k, v in preds.items()}
    stacked = bl.stack_predictions(preds)
    outputs = {f"{k}Pred": v.select("UniqueID", F.col("p").alias("Probability1")) for k, v in preds.items()}
    for name, weights in blends.items():
        outputs[f"{name}Pred"] = bl.blend(stacked, weights)
    # Chart data: densities, term bars, the topics' density over time, importance bars.
    from newsfeat.operators import charts
    days = feats.select(F.col("UniqueID").alias("doc_id"), F.datediff(F.to_date("PubDate"), F.lit("1970-01-01").cast("date")).alias("day"))
    dated = days.join(doc_topics, "doc_id").join(topic_terms, "topic")
    topic_counts = dated.groupBy("terms").agg(F.count(F.lit(1)).alias("n"))
    over_time = charts.scaled_density(dated, "day", "terms").join(topic_counts, "terms").select(
        F.lit(None).cast("string").alias("facet"), F.col("terms").alias("series"), F.col("i").cast("int").alias("i"), "x",
        (F.col("density") * F.col("n")).alias("y"))
    full_cols = md.feature_columns(frame, [c for c in full_ex if c in frame.columns])
    bagged = md.bagged_forest(frame, full_cols, num_trees, seed=seed)
    importance = tmx.ordered_bars(md.oob_importance(bagged, frame), "importance", "feature").select(
        F.lit(None).cast("string").alias("facet"), F.col("feature").alias("series"),
        F.col("bar_order").cast("int").alias("i"), F.lit(None).cast("double").alias("x"), F.col("importance").alias("y"))
    headline = tmx.frequent_terms(tmx.term_counts(tmx.corpus(feats, "UniqueID", "Headline", stopwords, 1, 1, stemmer)),
                                  fixed.FREQ_TERMS_HEADLINE_MIN)
    text = tmx.frequent_terms(w, fixed.FREQ_TERMS_TEXT_MIN_WEIGHT, "weight")
    series = chart_series(feats, {"headline_terms": tmx.ordered_bars(headline), "text_terms": tmx.ordered_bars(text)},
                          {"topics_over_time": over_time, "importance": importance})
    if out_dir:
        base = out_dir.rstrip("/")
        for name, df in outputs.items():
            csvio.write_submission(df, f"{base}/{fixed.SUBMISSION_PREFIX}{name}")
        csvio.write_named(series, f"{base}/charts", "parquet")
    return {"features": feats, "model_frame": frame, "topic_terms": topic_terms, "chart_series": series, **outputs}
