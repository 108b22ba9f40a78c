"""SimHash near-duplicates by vantage-point trees.

Fingerprints are cut into shards by a vantage-point tree over the Hamming
distance; points within reach of a boundary are copied to both sides, so that
every pair within the distance meets in some shard, where smaller trees and
exact distances find it.  No pair leaves its shard: each leaf reports one star
a component, and the stars of all shards are joined into components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import read, utf8
from newsfeat.llm.components import connected_components
from newsfeat.session import written_table

SEED = 42                 # of XXH64 over a shingle
SAMPLE = 16_384           # fingerprints that the shard tree is fitted on
SHARD_ROWS = 4_096        # distinct fingerprints aimed at per shard
SHARD_BOUND = 65_536      # rows above which a shard gets a tree of its own
LEAF_ROWS = 192           # below this a shard's tree compares all pairs


# --------------------------------------------------------------- fingerprints
def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text.

    ``bytes.lower`` and ``bytes.split`` act on A-Z and the six ASCII space
    characters only.  Shingles are cut from the re-joined words; votes are
    summed in blocks, so a long text never holds all its bits at once.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 16_384):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + 16_384].tolist(), ends[at:at + 16_384].tolist())], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)``, one row per input row; ``fp`` holds the 64
    bits as a signed long.  A null or empty text has the fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in batch.column(2)),
                              np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "text_hash", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                         utf8(text_col).alias("t"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, fp long")


# ---------------------------------------------------------- vantage-point tree
@dataclass
class Node:
    """An inner node; ``inside`` and ``outside`` are nodes or shard numbers."""

    point: np.uint64
    radius: int
    inside: Node | int
    outside: Node | int


def _split(points: np.ndarray, reach: int) -> tuple[np.uint64, int] | None:
    """The vantage point and radius with the least work on both sides (squares
    of their sizes, points that go to both counted twice); None if no split
    leaves less than nine tenths on each side."""
    best, found = np.inf, None
    for i in np.linspace(0, len(points) - 1, 12).astype(int):
        at_most = np.cumsum(np.bincount(np.bitwise_count(points ^ points[i]), minlength=65))
        radii = np.arange(64 - reach)
        inside = at_most[radii + reach].astype(float)
        outside = len(points) - np.where(radii >= reach, at_most[np.maximum(radii - reach, 0)], 0.0)
        work = np.where(np.maximum(inside, outside) < 0.9 * len(points), inside**2 + outside**2, np.inf)
        if work.min() < best:
            best, found = work.min(), (points[i], int(radii[work.argmin()]))
    return found


def _sides(points: np.ndarray, vantage: np.uint64, radius: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points go inside and which outside.

    By the triangle bound two points within ``2 * reach`` have distances to the
    vantage point that differ by as much at most, so one of the two sides holds
    both when each point also crosses a boundary less than ``reach`` away.
    """
    distance = np.bitwise_count(points ^ vantage).astype(np.int16)
    return distance - reach <= radius, distance + reach > radius


def fit_tree(sample: np.ndarray, leaf: float, reach: int) -> tuple[Node | int, int]:
    """A tree whose leaves hold ``leaf`` points of the sample or cannot be
    split, and the number of its leaves."""
    count = 0

    def grow(points: np.ndarray, depth: int) -> Node | int:
        nonlocal count
        split = _split(points, reach) if len(points) > leaf and depth < 24 else None
        if split is None:
            count += 1
            return count - 1
        inside, outside = _sides(points, *split, reach)
        return Node(*split, grow(points[inside], depth + 1), grow(points[outside], depth + 1))

    return grow(sample, 0), count


def route(tree: Node | int, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indexes of the points in it), the copies over boundaries included."""
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if isinstance(node, int):
            yield node, at
        elif len(at):
            inside, outside = _sides(points[at], node.point, node.radius, reach)
            stack += [(node.inside, at[inside]), (node.outside, at[outside])]


def _stars(points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smallest point of its component) among distinct points,
    found by a local tree and exact distances in its leaves."""
    reach = (distance + 1) // 2
    tree, _ = fit_tree(points, LEAF_ROWS, reach)
    ends, roots = [], []
    for _, at in route(tree, points, reach):
        own = np.sort(points[at].view(np.int64))
        label, bits = np.arange(len(own)), own.view(np.uint64)
        for lo, hi in _near(bits, distance):  # a leaf that can't be split is walked in blocks
            changed = True
            while changed:
                low = np.minimum(label[lo], label[hi])
                changed = bool((label[lo] != low).any() or (label[hi] != low).any())
                np.minimum.at(label, lo, low)
                np.minimum.at(label, hi, low)
                label = label[label]
        linked = label != np.arange(len(own))
        ends.append(own[linked])
        roots.append(own[label[linked]])
    return np.concatenate(ends), np.concatenate(roots)


def _near(bits: np.ndarray, distance: int, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the distance, one block of rows at a time."""
    for a in range(0, len(bits), block):
        for b in range(a, len(bits), 4 * block):
            lo, hi = np.nonzero(np.bitwise_count(bits[a:a + block, None] ^ bits[None, b:b + 4 * block]) <= distance)
            keep = lo + a < hi + b
            if keep.any():
                yield lo[keep] + a, hi[keep] + b


def split_large(dealt: DataFrame, reach: int, sample: int, shard_rows: int, bound: int) -> DataFrame:
    """Rows ``(shard, fp)`` with every shard above ``bound`` rows that can be
    split dealt again, by a tree fitted in a task on about ``sample`` of the
    shard's own rows, until none is left.  Rows of a large shard meet its tree
    in salted parts of about ``bound`` rows; no tree reaches the driver."""
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        tree, leaves = fit_tree(points, max(8, shard_rows * len(points) / int(pdf["n"].iloc[0])), reach)
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree)], "leaves": [leaves]})

    def deal(key: tuple, rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        fps = rows["fp"].to_numpy(np.int64)
        tree = pickle.loads(trees["tree"].iloc[0])
        parts = [(f"{key[0]}.{sub}", fps[at]) for sub, at in route(tree, fps.view(np.uint64), reach) if len(at)]
        return pd.DataFrame({"shard": [name for name, own in parts for _ in own],
                             "fp": np.concatenate([own for _, own in parts])})

    done = []
    while True:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n"))
        large = written_table(sizes.where(F.col("n") > bound), "simhash-large")
        if large.isEmpty():
            break
        rows = dealt.join(large, "shard")
        picked = rows.where(F.pmod(F.xxhash64("fp", "shard"), "n") < sample)
        trees = written_table(picked.groupBy("shard").applyInPandas(fit, "shard string, tree binary, leaves int")
                              .where("leaves > 1").join(large, "shard"), "simhash-trees")
        parts = F.ceil(F.col("n") / F.lit(bound)).cast("int")
        salted = (rows.join(trees.select("shard"), "shard", "left_semi")
                  .select("shard", F.pmod(F.xxhash64("fp"), parts).cast("int").alias("salt"), "fp"))
        spread = trees.select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), "tree")
        again = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(
            deal, "shard string, fp long")
        # What needs no split, or cannot be split, leaves the rounds.
        done.append(dealt.join(trees.select("shard"), "shard", "left_anti"))
        dealt = written_table(again, "simhash-dealt")
    for rest in done:
        dealt = dealt.unionByName(rest)
    return dealt


def fingerprint_links(distinct: DataFrame, distance: int = 2, sample: int = SAMPLE,
                      shard_rows: int = SHARD_ROWS, bound: int = SHARD_BOUND) -> DataFrame:
    """``(a, b)`` links that span the same components as all pairs of the
    distinct fingerprints ``fp`` within ``distance`` bits.

    The first tree is fitted on ``sample`` fingerprints, taken by hash order;
    every fingerprint is then routed through it, and shards above ``bound`` rows
    get trees of their own.  Samples only shape the shards: found pairs don't
    depend on them.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    chosen = [r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    points = np.array(chosen, np.int64).view(np.uint64)
    reach = (distance + 1) // 2
    tree, _ = fit_tree(points, max(8, shard_rows * len(points) / max(rows, 1)), reach)
    sent = spark.sparkContext.broadcast(tree)  # at most 2 x sample nodes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for shard, at in route(sent.value, fps.view(np.uint64), reach):
                yield pa.RecordBatch.from_arrays([pa.array([str(shard)] * len(at), pa.string()), pa.array(fps[at])],
                                                 names=["shard", "fp"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _stars(np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64), distance)
        return pd.DataFrame({"a": a, "b": b})

    dealt = written_table(distinct.select("fp").mapInArrow(deal, "shard string, fp long"), "simhash-dealt")
    return (split_large(dealt, reach, sample, shard_rows, bound)
            .groupBy("shard").applyInPandas(meet, "a long, b long"))


# -------------------------------------------------------------------- operator
def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(doc_id, text_hash, fp, component_id, first_hash)``, one row per input
    row; ``first_hash`` belongs to the text of the component's first document.

    Equal fingerprints are collapsed by a pre-aggregated minimum before any
    search, so copies cost one row a task.  Null and empty texts share the
    fingerprint 0 and link like others; repeated rows come back as often as
    they came; rows with a null id take part and get the smallest id that is
    reached (null if there is none); an empty table gives no rows.
    """
    prints = written_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = written_table(prints.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    roots = connected_components(fingerprint_links(distinct, distance))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = rooted.join(lowest, "root").select("fp", "lowest")
    # Written, so that the join with all rows stands alone and a hot fingerprint is split.
    classes = written_table(distinct.join(linked, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("lowest")),
                            "simhash-classes")
    return prints.join(classes, "fp").select(
        "doc_id", "text_hash", "fp", F.col("lowest.doc_id").alias("component_id"),
        F.col("lowest.text_hash").alias("first_hash"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns: of each
    group one row with the smallest id stays (rows without an id only in groups
    that have none; among rows that share the id, the smallest text hash)."""
    keep = written_table(
        simhash_components(docs, id_col, text_col, shingle, distance)
        .where("doc_id <=> component_id AND text_hash = first_hash")
        .groupBy(F.col("doc_id").alias("__keep_id"), F.col("text_hash").alias("__keep_hash"))
        .agg(F.count("*").alias("__rows")), "simhash-keep")
    kept = docs.join(keep.drop("__rows"), F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id"))
                     & (F.xxhash64(text_col) == F.col("__keep_hash")), "left_semi")
    if keep.where("__rows > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])  # rows that repeat both id and text


def q_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
