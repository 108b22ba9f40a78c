"""Execute headline queries and summarise their final (adaptive) physical plans.

usage: python scripts/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

QUERIES = ["model_frame", "temporal_counts", "day_section_dense", "hour_popularity", "ngrams_1_3", "tfidf",
           "bow_features", "top_terms_per_group", "ordered_bars", "auc", "blend", "kde_by_group_facet",
           "nearest_centroid", "stratified_partition", "term_popularity", "stem_vocabulary"]

OPERATORS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
             "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
             "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "ObjectHashAggregate",
             "SortAggregate", "Window", "Generate", "ArrowEvalPython", "BatchEvalPython", "AQEShuffleRead"]


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    qe = df._jdf.queryExecution()
    plan = qe.executedPlan()
    # After execution the adaptive plan holds its final form.
    return plan.toString()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from newsfeat.plans import catalog
    from newsfeat.session import build_session

    spark = build_session()
    print(f"# Physical plans of headline queries ({sf_dir}, local[8], AQE on)\n")
    print("Counts of physical operators in the final adaptive plan of each query, and the")
    print("columns each Parquet scan reads.  Generated by `scripts/plan_report.py`.\n")
    print("| query | " + " | ".join(o.replace("Exchange ", "Ex ") for o in OPERATORS) + " |")
    print("|---|" + "---|" * len(OPERATORS))
    scans = {}
    for name in QUERIES:
        df = catalog.REGISTRY[name].run(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        text = df._jdf.queryExecution().executedPlan().toString()
        counts = [text.count(o) for o in OPERATORS]
        print(f"| {name} | " + " | ".join(str(c) if c else "" for c in counts) + " |")
        scans[name] = sorted(set(re.findall(r"ReadSchema: (struct<[^>]*>)", text)))
    print("\n## Scan schemas (column pruning)\n")
    for name, rs in scans.items():
        print(f"* `{name}`: " + "; ".join(f"`{r}`" for r in rs))
    spark.stop()


if __name__ == "__main__":
    main()
