"""Parquet table readers for the test-data layout ``{dir}/{name}.parquet``.

Readers select only the columns asked for, so the scan's ``ReadSchema`` is
pruned even before Catalyst's own column pruning runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition by ``key`` only when the scan gives fewer partitions than
    the cluster can run at once (a small file in one row group).  A large scan
    is already split by ``spark.sql.files.maxPartitionBytes`` and is returned
    untouched, so no shuffle is added at scale.  Used before CPU-heavy
    per-row text work."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def documents(spark, sf_dir, columns=("doc_id", "text"), spread_rows: bool = True) -> DataFrame:
    df = read_table(spark, sf_dir, "documents", list(columns))
    return spread(df, "doc_id") if spread_rows else df


def labels(spark, sf_dir, columns=("doc_id", "quality")) -> DataFrame:
    return read_table(spark, sf_dir, "labels", list(columns))


def pages(spark, sf_dir, columns=("page_id", "html")) -> DataFrame:
    return spread(read_table(spark, sf_dir, "pages", list(columns)), "page_id")


def events(spark, sf_dir, columns=("event_id", "ts", "event_type")) -> DataFrame:
    return read_table(spark, sf_dir, "events", list(columns))


def embeddings(spark, sf_dir, columns=("vec_id", "embedding", "label")) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings", list(columns))
