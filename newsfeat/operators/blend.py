"""Weighted blends of model probabilities, keyed by article id.

Predictions are stacked in long form ``(model, UniqueID, p)`` - one row per
model and id - and reduced with one ``groupBy(UniqueID)`` (partial
aggregation, one shuffle) instead of joining one table per model.  A row
missing any blended model's prediction, or with a null one, gets a null blend (the script's vector
arithmetic would give NA): predictions that are not null are counted per id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.functions.fixed import BLENDS


def stack_predictions(preds: dict[str, DataFrame], id_col: str = "UniqueID", p_col: str = "p") -> DataFrame:
    parts = [df.select(F.lit(name).alias("model"), F.col(id_col).alias("UniqueID"),
                       F.col(p_col).cast("double").alias("p")) for name, df in preds.items()]
    return reduce(DataFrame.unionByName, parts)


def unpivot_predictions(df: DataFrame, columns: dict[str, str], id_col: str = "UniqueID") -> DataFrame:
    """Wide ``(id, p_model1, p_model2, ...)`` -> long ``(model, UniqueID, p)``
    in one pass (no union of re-computed branches)."""
    wide = df.select(F.col(id_col).alias("UniqueID"),
                     *[F.col(c).cast("double").alias(m) for m, c in columns.items()])
    return (wide.unpivot("UniqueID", list(columns), "model", "p")
                .select("model", "UniqueID", "p"))


def _merge_weights(weights) -> dict[str, float]:
    items = weights.items() if isinstance(weights, dict) else weights
    out: dict[str, float] = {}
    for m, w in items:
        out[m] = out.get(m, 0.0) + float(w)
    return out


def blend(stacked: DataFrame, weights) -> DataFrame:
    """``sum(w * p) / sum(w)`` per id; ``weights`` is a dict or a list of
    ``(model, weight)`` pairs (a model may appear twice)."""
    w = _merge_weights(weights)
    total = sum(w.values())
    wmap = F.create_map(*[x for m, v in w.items() for x in (F.lit(m), F.lit(v))])
    used = stacked.where(F.col("model").isin(list(w)))
    return (used.groupBy("UniqueID")
                .agg(F.count("p").alias("__m"),
                     F.sum(F.element_at(wmap, F.col("model")) * F.col("p")).alias("__s"))
                .select("UniqueID", F.when(F.col("__m") == len(w), F.col("__s") / total).alias("Probability1")))


def all_blends(stacked: DataFrame, blends: dict = BLENDS) -> DataFrame:
    """Every named blend, long form ``(blend, UniqueID, Probability1)``: one
    ``groupBy(UniqueID)`` holds a weighted sum and a count per blend, and the wide
    result is unpivoted, so no row is multiplied before the shuffle."""
    weights = {name: _merge_weights(ws) for name, ws in blends.items()}
    sums = []
    for i, w in enumerate(weights.values()):
        weight = F.element_at(F.create_map(*[x for m, v in w.items() for x in (F.lit(m), F.lit(v))]), F.col("model"))
        own = F.col("model").isin(list(w))
        sums += [F.count(F.when(own, F.col("p"))).alias(f"__m{i}"), F.sum(F.when(own, weight * F.col("p"))).alias(f"__s{i}")]
    wide = stacked.groupBy("UniqueID").agg(*sums).select(
        "UniqueID", *[F.when(F.col(f"__m{i}") == len(w), F.col(f"__s{i}") / sum(w.values())).alias(name)
                      for i, (name, w) in enumerate(weights.items())])
    return wide.unpivot("UniqueID", list(weights), "blend", "Probability1").select("blend", "UniqueID", "Probability1")


def submissions(stacked: DataFrame, blends: dict = BLENDS) -> DataFrame:
    """``(name, UniqueID, Probability1)``: every model's own prediction and every
    blend, named as the script's prediction vectors are."""
    own = stacked.select(F.concat("model", F.lit("Pred")).alias("name"), "UniqueID", F.col("p").alias("Probability1"))
    mixed = all_blends(stacked, blends).select(F.concat("blend", F.lit("Pred")).alias("name"), "UniqueID", "Probability1")
    return own.unionByName(mixed)
