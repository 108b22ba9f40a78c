"""Bottom-up Ward clustering over mergeable clustering features.

Rows (terms) become at most ``features`` clustering features: a count, a linear
sum and a square sum, which add up when features merge.  Which rows share a
feature is found on short sketches by a tree reduce of the same Ward merging;
the features themselves are then summed from the whole rows, and their inner
products alone go into the final merging, so no matrix of row pairs is formed
and the depth of the tree costs no Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.session import written_table

FEATURES = 512    # clustering features: their inner products are what the driver gets
DIMS = 128        # numbers of a sketch
SPREAD = 4        # numbers of a sketch that a feature of the rows adds to
FAN_IN = 4        # reduced blocks that merge into one


def ward(distance: np.ndarray, sizes: np.ndarray, stop: int = 1) -> tuple[list[tuple[int, int, float]], np.ndarray]:
    """Merges ``(left, right, height)`` by rising height, until ``stop`` clusters
    are left, and each start's cluster then (numbered from 0 by first member).
    Starts are nodes 0 to n - 1, the s-th merge makes node n + s.

    Chains of nearest neighbours with Ward's update of the distances: on squared
    distances the classic criterion, on plain ones what R calls ``ward.D``."""
    n = len(sizes)
    d, size = distance.astype(float), sizes.astype(float)
    np.fill_diagonal(d, np.inf)
    alive, found, chain = np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        found.append((a, b, float(d[a, b])))
        total = size[a] + size[b] + size
        merged = ((size[a] + size) * d[a] + (size[b] + size) * d[b] - size * d[a, b]) / total
        merged[~alive] = np.inf
        merged[[a, b]] = np.inf
        d[a], d[:, a] = merged, merged
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
        size[a] += size[b]
    # A merge never comes before those of its parts, which are no higher.
    root, node, merges = np.arange(n), np.arange(n), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, height in sorted(found, key=lambda m: m[2])[:max(n - stop, 0)]:
        a, b = sorted((top(a), top(b)))
        merges.append((int(min(node[a], node[b])), int(max(node[a], node[b])), height))
        root[b], node[a] = a, n + len(merges) - 1
    return merges, np.unique([top(i) for i in range(n)], return_inverse=True)[1]


def _squared(centres: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Twice the rise of the within-sum if two features merge."""
    norms = (centres ** 2).sum(1)
    apart = np.maximum(norms[:, None] + norms - 2 * centres @ centres.T, 0)
    return 2 * np.outer(n, n) / np.add.outer(n, n) * apart


def sketches(points: DataFrame, dims: int = DIMS, spread: int = SPREAD, seed: int = 1) -> DataFrame:
    """``(id, v)``: each row's random projection to ``dims`` numbers.  A feature
    adds to ``spread`` of them with hashed signs; sums are partial per task, so
    a row of very many entries is spread."""
    h = F.xxhash64("feature", "j", F.lit(seed))
    parts = (points.select("id", "feature", "w", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("j"))
             .select("id", F.pmod(h, F.lit(dims)).cast("int").alias("k"),
                     (F.col("w") * F.when(F.pmod(F.shiftright(h, 20), F.lit(2)) == 0, 1.0).otherwise(-1.0)
                      / F.sqrt(F.lit(float(spread)))).alias("x"))
             .groupBy("id", "k").agg(F.sum("x").alias("x")))
    entries = F.map_from_entries(F.collect_list(F.struct("k", "x")))
    return (parts.groupBy("id").agg(entries.alias("m"))
            .select("id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)),
                                      lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("v")))


def reduced(rows: DataFrame, count: int, features: int) -> list[tuple[int, list[float]]]:
    """At most ``features`` (count, linear sum) of the sketches ``(id, v)``: Ward
    merging inside blocks of about ``FAN_IN * features`` rows, then inside groups
    of ``FAN_IN`` reduced blocks, until one block is left."""
    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, total = pdf["n"].to_numpy(float), np.stack(pdf["v"].to_numpy())
        label = np.arange(len(n))
        if len(n) > features:
            label = ward(_squared(total / n[:, None], n), n, features)[1]
        sums = np.zeros((label.max() + 1, total.shape[1]))
        np.add.at(sums, label, total)
        return pd.DataFrame({"block": key[0] // FAN_IN, "n": np.bincount(label, n).astype("int64"), "v": list(sums)})

    blocks = -(-count // (FAN_IN * features))
    state = rows.select(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).alias("block"), F.lit(1).cast("long").alias("n"), "v")
    while True:
        state = written_table(state.groupBy("block").applyInPandas(merge, "block long, n long, v array<double>"), "ward-reduce")
        if blocks == 1:
            return [(r.n, r.v) for r in state.orderBy("v").collect()]
        blocks = -(-blocks // FAN_IN)


def nodes(points: DataFrame, features: int = FEATURES, dims: int = DIMS, seed: int = 1) -> DataFrame:
    """``(id, node)``: the clustering feature of each row, numbered from 0; a row
    alone in its own one if there are no more than ``features`` rows."""
    spark = points.sparkSession
    points = points.where("id IS NOT NULL")
    ids = written_table(points.select("id").distinct(), "ward-ids")
    count = ids.count()
    schema = f"id {points.schema['id'].dataType.simpleString()}, node int"
    if count <= features:
        return spark.createDataFrame([(r.id, i) for i, r in enumerate(ids.orderBy("id").collect())], schema)
    short = written_table(sketches(points, dims, seed=seed), "ward-sketches")
    centres = np.array([np.array(v) / n for n, v in reduced(short, count, features)])
    norms = (centres ** 2).sum(1)

    def nearest(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if len(pdf):
                v = np.stack(pdf["v"].to_numpy())
                yield pd.DataFrame({"id": pdf["id"], "node": (norms - 2 * v @ centres.T).argmin(1).astype("int32")})

    found = written_table(short.mapInPandas(nearest, schema), "ward-nodes")
    used = [r.node for r in found.select("node").distinct().orderBy("node").collect()]
    if len(used) == len(centres):
        return found
    number = F.create_map(*[F.lit(x) for i, old in enumerate(used) for x in (old, i)])  # no row is nearest to the others
    return found.select("id", number[F.col("node")].alias("node"))


def feature_products(points: DataFrame, members: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, square sums and inner products of the linear sums of the clustering
    features, from the whole rows.  A task adds up one table of all products."""
    joined = points.join(members, "id")
    counts = np.array([r.n for r in members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).orderBy("node").collect()], float)
    size = len(counts)
    squares, gram = np.zeros(size), np.zeros((size, size))
    sums = written_table(joined.groupBy("feature", "node").agg(
        F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")), "ward-sums")
    for r in sums.groupBy("node").agg(F.sum("q").alias("q")).collect():
        squares[r.node] = r.q

    def products(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((size, size))
        for pdf in pdfs:
            lengths = pdf["p"].str.len().to_numpy()
            row = np.repeat(np.arange(len(pdf)), lengths)
            flat = [x for p in pdf["p"] for x in p]
            for lo in range(0, len(pdf), 1024):  # rows of a dense block at a time
                at = slice(*np.searchsorted(row, [lo, lo + 1024]))
                block = np.zeros((min(1024, len(pdf) - lo), size))
                block[row[at] - lo, [x["node"] for x in flat[at]]] = [x["s"] for x in flat[at]]
                own += block.T @ block
        a, b = np.nonzero(np.triu(own))
        yield pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32"), "x": own[a, b]})

    by_feature = sums.groupBy("feature").agg(F.collect_list(F.struct("node", "s")).alias("p")).select("p")
    for r in by_feature.mapInPandas(products, "a int, b int, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect():
        gram[r.a, r.b] = gram[r.b, r.a] = r.x
    return counts, squares, gram


def ward_tree(points: DataFrame, features: int = FEATURES, dims: int = DIMS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(merges, members)`` of the rows ``(id, feature, w)``.

    ``merges`` is ``(step, left, right, height, size, within)``: nodes below the
    number of clustering features are these, step s (from 1) makes the next one;
    ``size`` counts rows, ``within`` is the square sum around the merged mean.
    ``members`` is ``(id, node)``.  Heights are those of R's ``ward.D`` on plain
    Euclidean distances; with one row a feature the tree is exactly that one,
    else rows that share a feature count as merged before (``within`` tells at
    what loss).

    Null ids are left out, null weights and absent entries are 0, repeated
    entries add up.  Equal heights merge in no promised order.  One row or none
    has no merges."""
    spark = points.sparkSession
    rows = written_table(points.where("id IS NOT NULL").groupBy("id", "feature").agg(
        F.coalesce(F.sum(F.col("w").cast("double")), F.lit(0.0)).alias("w")), "ward-rows")
    members = nodes(rows, features, dims, seed)
    n, squares, gram = feature_products(rows, members)
    norms = np.diag(gram) / np.maximum(n, 1) ** 2
    apart = np.maximum(norms[:, None] + norms - 2 * gram / np.maximum(np.outer(n, n), 1), 0)
    weight = 2 * np.outer(n, n) / np.maximum(np.add.outer(n, n), 1)
    merges, _ = ward(weight * np.sqrt(apart), n)
    size, q, held, out = list(n), list(squares), [np.array([i]) for i in range(len(n))], []
    for step, (a, b, height) in enumerate(merges, 1):
        size.append(size[a] + size[b])
        q.append(q[a] + q[b])
        held.append(np.concatenate((held[a], held[b])))
        within = q[-1] - gram[np.ix_(held[-1], held[-1])].sum() / size[-1]
        out.append((step, a, b, height, int(size[-1]), float(max(within, 0.0))))
    return spark.createDataFrame(out, "step int, left int, right int, height double, size long, within double"), members
