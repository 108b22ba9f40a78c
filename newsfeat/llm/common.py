"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the corpus contracts: runs without the ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(id_col: str, n: int) -> Column:
    """Fold of a row: crc32 of its id as text, modulo ``n`` (null id: 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(0))


def utf8(col: str) -> Column:
    """The text as UTF-8 bytes, null as empty: Python workers decode these
    themselves, so that bytes which are no UTF-8 stop no job."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")

