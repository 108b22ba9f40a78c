"""Union of labelled and unlabelled halves, and the label split.

Rows are identified by ``UniqueID``; the split is on the label being null,
never on row position (``head``/``tail`` would only be right if every
labelled row came first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_train_test(train: DataFrame, test: DataFrame, label: str = "Popular") -> DataFrame:
    """Stack both halves by column name (duplicates kept); the unlabelled half
    gets a null label column when it has none."""
    if label not in test.columns:
        test = test.withColumn(label, F.lit(None).cast(train.schema[label].dataType))
    return train.unionByName(test)


def split_labelled(df: DataFrame, label: str = "Popular") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(label).isNotNull()), df.where(F.col(label).isNull())
