"""Publication counts joined back to every article, and the hour x label table.

Plan shape (``with_temporal_counts``): one partial-then-final aggregate to the
finest grain ``(PubDay, SectionName, Hour)`` - its size is bounded by the
calendar and the category count, never by the article count - then the three
counts as window sums over that small table, then **one** left join back on
the three keys.  AQE turns the join into a broadcast hash join from the
aggregate's measured runtime size (``autoBroadcastJoinThreshold``) and keeps a
sort-merge join otherwise, so the wide article rows are never shuffled when
the count table is small and nothing is broadcast that was not measured.  A
day holding a third of all rows costs one partial-aggregate row per task.

Null keys: rows with a null day get null counts (the script's ``table`` drops
null keys and its ``merge`` leaves such rows unmatched).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY, SECTION, HOUR = "PubDay", "SectionName", "Hour"


def count_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``table(keys)`` in long form, null keys dropped."""
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def temporal_count_table(df: DataFrame) -> DataFrame:
    fine = count_by(df, [DAY, SECTION, HOUR], "__n")
    return fine.select(
        DAY, SECTION, HOUR,
        F.sum("__n").over(Window.partitionBy(DAY)).alias("NumDailyArticles"),
        F.sum("__n").over(Window.partitionBy(DAY, SECTION)).alias("NumDailySectionArticles"),
        F.sum("__n").over(Window.partitionBy(DAY, HOUR)).alias("NumHourlyArticles"),
    )


# Largest count table broadcast to every task (rows); above it the join stays
# a sort-merge join (with AQE's skew split).
MAX_BROADCAST_ROWS = 2_000_000


def with_temporal_counts(df: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add ``NumDailyArticles``, ``NumDailySectionArticles``, ``NumHourlyArticles``.

    The small count table is written once (to the shared checkpoint folder, so
    that a lost executor does not lose it), its row count is checked, and it is
    broadcast only below ``max_broadcast_rows``."""
    return df.join(_checked(temporal_count_table(df), max_broadcast_rows), [DAY, SECTION, HOUR], "left")


def _checked(counts: DataFrame, max_broadcast_rows: int) -> DataFrame:
    """A count table, written once and broadcast if it is small enough."""
    from newsfeat.session import written_table
    counts = written_table(counts, "counts")
    return F.broadcast(counts) if counts.count() <= max_broadcast_rows else counts


def with_count(df: DataFrame, keys: list[str], name: str, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One count joined back (``merge(x, table(keys), all.x=TRUE)``); the wide
    rows stay where they are while the count table is small."""
    return df.join(_checked(count_by(df, keys, name), max_broadcast_rows), keys, "left")


def dense_counts(df: DataFrame, row_key: str, col_key: str, name: str = "n") -> DataFrame:
    """Zero-filled contingency table in long form (every row level x column level).

    Column levels are numbered by a range-partitioned rank; each row level is
    spread over the numbers and meets the counts and the level names by keyed
    joins.  Nothing but the number of column levels goes to the driver, so only
    the table itself, rows x columns by its meaning, bounds the levels.  Null
    levels are left out, as in the script's ``table``."""
    from newsfeat.operators.textmining import global_rank
    from newsfeat.session import written_table
    src = df.where(F.col(row_key).isNotNull() & F.col(col_key).isNotNull())
    counts = written_table(src.groupBy(row_key, col_key).agg(F.count(F.lit(1)).alias("__n")), "contingency")
    levels = written_table(global_rank(counts.select(col_key).distinct(), [col_key], "__no"), "levels")
    number = levels.count()
    if not number:
        return counts.select(row_key, col_key, F.col("__n").alias(name))
    numbered = counts.join(levels, col_key).select(row_key, F.col("__no").cast("int").alias("__no"), "__n")
    grid = counts.select(row_key).distinct().withColumn("__no", F.explode(F.sequence(F.lit(1), F.lit(number))))
    return (grid.join(numbered, [row_key, "__no"], "left")
            .join(levels.withColumn("__no", F.col("__no").cast("int")), "__no")
            .select(row_key, col_key, F.coalesce("__n", F.lit(0)).cast("long").alias(name)))


def hour_popularity(df: DataFrame, hour: str = HOUR, label: str = "Popular") -> DataFrame:
    """Per hour: unpopular and popular counts and the popular share.

    Unlabelled rows are not counted but their hours are kept (0, 0, null share
    where the script yields NaN)."""
    agg = df.where(F.col(hour).isNotNull()).groupBy(hour).agg(
        F.count_if(F.col(label) == 0).alias("Unpopular"),
        F.count_if(F.col(label) == 1).alias("Popular"),
    )
    return agg.withColumn("PopularDensity",
                          F.try_divide(F.col("Popular").cast("double"), F.col("Unpopular") + F.col("Popular")))
