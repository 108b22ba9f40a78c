"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.session import written_table


def _distinct_links(df: DataFrame) -> DataFrame:
    """Undirected links as (hi, lo) with hi > lo, each once."""
    return (df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
            .where("hi > lo").distinct())


def _state(df: DataFrame):
    return df.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node.

    ``links(a, b)`` are long node ids; the result is ``(node, root)`` for every
    node that has a link to another one, the root itself included.  Alternating
    large-star and small-star rounds: every link is re-hung on the smallest
    neighbour until nothing changes, so the table never grows beyond its first
    size and ends as one star a component.  A hot centre only makes a skewed
    join, which adaptive execution splits; its minimum is pre-aggregated.  Each
    round is a written table, so a lost executor costs one round at most.
    Null ends are dropped; an empty table gives an empty result.
    """
    links = written_table(_distinct_links(links.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    before = _state(links)
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        smallest = (both.groupBy("u").agg(F.min("v").alias("m"))
                    .select("u", F.least("u", "m").alias("m")))
        large = (both.where("v > u").join(smallest, "u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")))
        links = written_table(_distinct_links(large), "large-star")
        lowest = links.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (links.join(lowest, "hi").select(F.col("lo").alias("a"), F.col("m").alias("b"))
                 .unionByName(lowest.select(F.col("hi").alias("a"), F.col("m").alias("b"))))
        links = written_table(_distinct_links(small), "small-star")
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
