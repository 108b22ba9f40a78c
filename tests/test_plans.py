"""Plan-shape checks on registered queries."""

import pytest

from newsfeat.plans import catalog
from tests.conftest import SF_SMALL

NO_PYTHON = ["model_frame", "temporal_counts", "tfidf", "ngrams_1_3", "auc", "blend", "kde_by_group",
             "nearest_centroid", "headline_flags", "bow_features", "day_section_dense", "term_popularity",
             "ordered_bars", "top_terms_per_group", "stratified_partition", "kde_by_group_facet"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_or_cartesian(spark, name):
    plan = plan_of(catalog.REGISTRY[name].run(spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stemming_is_the_only_python(spark):
    plan = plan_of(catalog.REGISTRY["stem_vocabulary"].run(spark, SF_SMALL))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" in plan


def test_scan_pruned_to_needed_columns(spark):
    plan = plan_of(catalog.REGISTRY["word_counts"].run(spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_temporal_counts_single_join(spark):
    plan = plan_of(catalog.REGISTRY["temporal_counts"].run(spark, SF_SMALL))
    # one fine-grain aggregate joined back once (plus the labels join of the fixture)
    assert plan.count("Join") <= 4


def test_count_join_is_size_checked_broadcast(spark):
    from newsfeat.operators import temporal as tm
    from newsfeat.plans.catalog import features
    df = features(spark, SF_SMALL)
    plan = plan_of(df)
    assert "BroadcastHashJoin" in plan
    # Above the bound the same join stays a shuffle join.
    big = tm.with_temporal_counts(features(spark, SF_SMALL, counts=False), max_broadcast_rows=0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(big)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
