"""CSV source (the article files) and CSV / Parquet sinks.

Reading: header row, ``"`` quoting with doubled quotes, embedded newlines,
declared schema (no inference pass).  Spark reads an unquoted blank field as
null; the script's reader keeps it as ``''``, and blanks are the "missing
category" marker, so text columns are coalesced to ``''`` after the scan.  The
literal ``NA`` is read as null (and therefore also becomes ``''`` in text
columns, while ``Popular`` stays null = unlabelled).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsfeat.functions.calendar import parse_pubdate

TEXT_COLUMNS = ["NewsDesk", "SectionName", "SubsectionName", "Headline", "Snippet", "Abstract"]

ARTICLE_CSV_SCHEMA = T.StructType([
    T.StructField("NewsDesk", T.StringType()),
    T.StructField("SectionName", T.StringType()),
    T.StructField("SubsectionName", T.StringType()),
    T.StructField("Headline", T.StringType()),
    T.StructField("Snippet", T.StringType()),
    T.StructField("Abstract", T.StringType()),
    T.StructField("WordCount", T.IntegerType()),
    T.StructField("PubDate", T.StringType()),
    T.StructField("Popular", T.IntegerType()),
    T.StructField("UniqueID", T.LongType()),
])


def csv_options() -> dict:
    return {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
            "nullValue": "NA", "mode": "FAILFAST",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_articles_csv(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_CSV_SCHEMA,
                      labelled: bool = True) -> DataFrame:
    """Read one article CSV, columns by the names of its header in any order; an
    unlabelled file has no ``Popular`` column, and a missing one is an error.

    Quoted line breaks make a file one task (``multiLine``), so large inputs
    should come as many files, as ``write_articles_csv`` leaves them."""
    raw = spark.read.options(**csv_options()).csv(path)
    fields = [f for f in schema.fields if labelled or f.name != "Popular"]
    df = raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
    if not labelled:
        df = df.withColumn("Popular", F.lit(None).cast("int"))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in TEXT_COLUMNS}
                          | {"PubDate": parse_pubdate("PubDate")})


def write_articles_csv(df: DataFrame, path: str) -> None:
    """Write articles in the source layout (PubDate as ``yyyy-MM-dd HH:mm:ss``)."""
    out = df.withColumn("PubDate", F.date_format("PubDate", "yyyy-MM-dd HH:mm:ss"))
    (out.select(*[f.name for f in ARTICLE_CSV_SCHEMA.fields])
        .write.mode("overwrite").options(**csv_options()).csv(path))


def write_submission(predictions: DataFrame, path: str, probability_col: str = "Probability1") -> None:
    """Submission file: ``UniqueID, Probability1``, header, one row per scored article."""
    (predictions.select("UniqueID", F.col(probability_col).alias("Probability1"))
        .write.mode("overwrite").option("header", "true").csv(path))


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("UniqueID", T.LongType()),
                           T.StructField("Probability1", T.DoubleType())])
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_named(df: DataFrame, path: str, kind: str = "csv", name_col: str = "name") -> None:
    """Many outputs in one write: a folder ``name=...`` each, and a manifest of the
    rows of every output (``path/_manifest``, which readers of ``path`` skip).
    Rows without a name are an error, since no reader could find them."""
    from newsfeat.session import written_table
    held = written_table(df, "named-outputs")  # counted and written from the same rows
    counts = held.groupBy(name_col).agg(F.count(F.lit(1)).alias("rows"))
    if not counts.where(F.col(name_col).isNull()).isEmpty():
        raise ValueError(f"rows without {name_col}")
    writer = held.write.mode("overwrite").partitionBy(name_col)
    (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(path)
    counts.write.mode("overwrite").json(f"{path.rstrip('/')}/_manifest")


def read_named(spark: SparkSession, path: str, schema: T.StructType, kind: str = "csv",
               name_col: str = "name") -> DataFrame:
    """All outputs of ``write_named`` with their names, by partition discovery."""
    full = T.StructType([*schema.fields, T.StructField(name_col, T.StringType())])
    reader = spark.read.schema(full)
    return (reader.option("header", "true") if kind == "csv" else reader).format(kind).load(path)


def read_manifest(spark: SparkSession, path: str, name_col: str = "name") -> DataFrame:
    """``(name, rows)`` of the outputs that were written."""
    return spark.read.schema(f"{name_col} string, rows long").json(f"{path.rstrip('/')}/_manifest")


SUBMISSION_SCHEMA = T.StructType([T.StructField("UniqueID", T.LongType()), T.StructField("Probability1", T.DoubleType())])


def write_chart_data(df: DataFrame, path: str) -> None:
    """Chart series are kept as data (Parquet); drawing is not part of the library."""
    df.write.mode("overwrite").parquet(path)
