"""Registered queries vs their DuckDB oracle SQL on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from newsfeat.plans import catalog
from scripts.check_oracle import TABLES, digest
from tests.conftest import SF_SMALL

FAST = ["csv_scan", "trim_ws", "strip_tags", "cleanup_text", "phrase_collapse", "word_counts", "calendar_parts",
        "holiday_flags", "fill_missing", "headline_flags", "reference_flags", "temporal_counts",
        "day_section_dense", "hour_popularity", "model_frame", "doc_term_counts", "remove_sparse_terms",
        "tfidf", "bow_features", "top_terms_concat", "accuracy", "auc", "blend", "kde_by_group_facet",
        "nearest_centroid", "unpivot_flags", "stratified_partition", "label_series"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    got = digest(E.queries()[name](spark, SF_SMALL).toPandas())
    want = digest(duck.execute(E.oracle_sql()[name]).df())
    assert got[:3] == want[:3]


def test_every_query_has_sql_or_is_model_output():
    rows_only = set(catalog.queries()) - set(catalog.oracle_sql())
    allowed = {"kmeans_topics", "cluster_top_terms", "oob_evaluation", "oob_importance", "rf_tuned", "lda_topics", "lda_topic_terms", "topic_series",
               "topic_density", "rf_full", "rf_selected", "rf_kmeans", "rf_lda", "rf_bow", "logistic",
               "rf_oob_eval", "permutation_importance", "stem_vocabulary", "rf_tuned", "term_hierarchy", "term_merges", "term_nodes"}
    assert rows_only <= allowed


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
