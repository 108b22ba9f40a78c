"""Approximate nearest neighbours by one navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id.  A shard's graph is built by
one task and stored as flat arrays in a table; blocks of queries are sent to
every shard, whose graph is shipped once per slice of many blocks; the shards'
best are merged.

The measure is the inner product.  Vectors get one more component that brings
them to the same length, so that for graph building near means a small angle,
and for a query (0 there) the order is that of the inner product itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsfeat.llm.common import partitions, read
from newsfeat.session import written_table

SHARD_ROWS = 8_192     # vectors of a shard, about
LINKS = 16             # neighbours that a node chooses on each layer (twice as many fit on the lowest)
EF_BUILD = 64          # nodes kept while a node looks for its neighbours
EF_SEARCH = 128        # nodes kept while a query is answered
AT_ONCE = 8            # nodes that a step of a walk opens
QUERY_BLOCK = 256      # queries of a block
SLICE_BLOCKS = 16      # blocks that share one copy of a shard's graph, about
TOP = 20


@dataclass
class Graph:
    """``links[0]`` has a row of neighbours for each node, -1 where there is
    none; the node numbers of higher layers are those below ``sizes[layer]``
    after sorting nodes by level, so a layer is a prefix of the nodes."""

    vectors: np.ndarray
    links: list[np.ndarray]

    def __post_init__(self):
        self.slot = np.zeros(len(self.vectors), np.int32)

    def climb(self, layer: int, q: np.ndarray, entry: int) -> int:
        """Walks uphill from a node until no neighbour is nearer."""
        links, here = self.links[layer], float(self.vectors[entry] @ q)
        while True:
            near = links[entry]
            near = near[near >= 0]
            if not len(near):
                return entry
            likeness = self.vectors[near] @ q
            if likeness.max() <= here:
                return entry
            entry, here = int(near[likeness.argmax()]), float(likeness.max())

    def layer_search(self, layer: int, q: np.ndarray, entry: int, ef: int, seen: np.ndarray, mark: int):
        """The likeness and numbers of the ``ef`` nearest nodes met by best-first
        walking.  Each step opens the ``AT_ONCE`` nearest nodes not yet opened, so
        that numpy works on all their neighbours together."""
        vectors, links = self.vectors, self.links[layer]
        seen[entry] = mark
        nodes = np.array([entry], np.int32)
        likeness, fresh = vectors[nodes] @ q, np.ones(1, bool)
        while True:
            ahead = np.flatnonzero(fresh)
            if not len(ahead):
                return likeness, nodes
            if len(ahead) > AT_ONCE:
                ahead = ahead[np.argpartition(-likeness[ahead], AT_ONCE)[:AT_ONCE]]
            fresh[ahead] = False
            near = links[nodes[ahead]].ravel()
            near = near[near >= 0]
            near = near[seen[near] != mark]
            if not len(near):
                continue
            nth = np.arange(len(near), dtype=np.int32)
            self.slot[near] = nth  # of a node that is listed twice the last one counts
            near = near[self.slot[near] == nth]
            seen[near] = mark
            found = vectors[near] @ q
            if len(nodes) >= ef:
                keep = found > likeness.min()
                near, found = near[keep], found[keep]
            nodes, likeness = np.concatenate((nodes, near)), np.concatenate((likeness, found))
            fresh = np.concatenate((fresh, np.ones(len(near), bool)))
            if len(nodes) > ef:
                best = np.argpartition(-likeness, ef - 1)[:ef]
                nodes, likeness, fresh = nodes[best], likeness[best], fresh[best]

    def search(self, q: np.ndarray, ef: int, seen: np.ndarray, mark: int) -> np.ndarray:
        entry = 0
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.climb(layer, q, entry)
        return self.layer_search(0, q, entry, ef, seen, mark)[1]


def spread(vectors: np.ndarray, nodes: np.ndarray, likeness: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates, nearest first, those nearer to the node than to any
    one chosen before; then the nearest others while there is room."""
    order = np.argsort(-likeness, kind="stable")
    nodes, likeness = nodes[order], likeness[order]
    between = vectors[nodes] @ vectors[nodes].T
    chosen: list[int] = []
    closest = np.full(len(nodes), -np.inf)
    for i in range(len(nodes)):
        if likeness[i] > closest[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            np.maximum(closest, between[i], out=closest)
    taken = set(chosen)
    rest = [i for i in range(len(nodes)) if i not in taken][:most - len(chosen)]
    return nodes[chosen + rest]


def build(vectors: np.ndarray, seed: int, m: int = LINKS, ef: int = EF_BUILD) -> tuple[Graph, np.ndarray]:
    """The graph of distinct, equally long vectors, and the order its nodes
    have: by falling level, so that node 0 is the entry and layers are prefixes."""
    n = len(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(m)).astype(int)
    order = np.argsort(-level, kind="stable")
    vectors, level = np.ascontiguousarray(vectors[order], np.float32), level[order]
    top = int(level[0]) if n else 0
    graph = Graph(vectors, [np.full((int((level >= l).sum()), m * (2 if l else 4)), -1, np.int32) for l in range(top + 1)])
    count = [np.zeros(len(x), np.int32) for x in graph.links]
    seen = np.zeros(n, np.int32)
    for node in range(1, n):
        q, entry = vectors[node], 0
        for layer in range(top, -1, -1):
            if layer > level[node]:
                entry = graph.climb(layer, q, entry)
                continue
            likeness, near = graph.layer_search(layer, q, entry, ef, seen, node * (top + 1) + layer)
            entry = int(near[likeness.argmax()])
            mine = spread(vectors, near, likeness, m)
            links, used = graph.links[layer], count[layer]
            links[node, :len(mine)] = mine
            used[node] = len(mine)
            for other in mine.tolist():
                if used[other] == links.shape[1]:  # full: keep half of them, well spread
                    kept = spread(vectors, links[other], vectors[links[other]] @ vectors[other], links.shape[1] // 2)
                    links[other] = -1
                    links[other, :len(kept)] = kept
                    used[other] = len(kept)
                links[other, used[other]] = node
                used[other] += 1
    return graph, order


# ------------------------------------------------------------------------ index
def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v, dim)`` of the vectors that take part.

    Rows with a null id, and vectors that are null, empty or zero or hold a null
    or non-finite component, take no part; repeated rows stay (they count once
    later); an empty table gives an empty one.  Other columns are left behind.
    """
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
            .withColumn("dim", F.size("v")))


def _shard(vec_id: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(vec_id), shards).cast("int")


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, top: int = TOP) -> DataFrame:
    """A table with a row per shard: its graph as flat arrays.

    Equal vectors of a shard are one node with the ``top`` + 1 smallest ids that
    share it, which is all that a query can return of them; rows that repeat an
    id count once.  Shards of vectors of other lengths are apart.
    """
    dims = vectors.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))  # a row per vector length
    dealt = vectors.join(F.broadcast(dims), "dim").withColumn("shard", _shard(F.col("vec_id"), F.col("shards")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, shard, shards = (int(pdf[c].iloc[0]) for c in ("dim", "shard", "shards"))
        rows = np.stack(pdf["v"].to_numpy())
        order = np.lexsort((*rows.T[::-1], pdf["vec_id"].to_numpy()))
        ids, rows = pdf["vec_id"].to_numpy()[order], rows[order]
        ids, first = np.unique(ids, return_index=True)
        distinct, node = np.unique(rows[first], axis=0, return_inverse=True)
        length = np.einsum("ij,ij->i", distinct, distinct)
        level = np.hstack([distinct, np.sqrt(np.maximum(length.max() - length, 0))[:, None]])
        graph, order = build(level / np.sqrt(length.max()), seed=shard)
        members = np.full((len(distinct), top + 1), -1, np.int64)
        by_node = np.argsort(node.ravel(), kind="stable")  # ids are sorted, so each node's are
        sizes = np.bincount(node.ravel(), minlength=len(distinct))
        nth = np.arange(len(by_node)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        small = nth <= top
        members[node.ravel()[by_node][small], nth[small]] = ids[by_node][small]
        return pd.DataFrame([{
            "dim": dim, "shard": shard, "shards": shards, "vectors": distinct[order].tobytes(),
            "members": members[order].tobytes(), "level": graph.vectors.tobytes(),
            "widths": [x.shape[1] for x in graph.links], "links": [x.tobytes() for x in graph.links]}])

    return written_table(dealt.groupBy("dim", "shard").applyInPandas(
        one, "dim int, shard int, shards long, vectors binary, members binary, level binary, "
             "widths array<int>, links array<binary>"), "hnsw")


def search(index: DataFrame, queries: DataFrame, top: int = TOP, ef: int = EF_SEARCH) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``top`` nearest that the graphs
    give, the query's own id left out; scores are double-precision inner products
    of the original vectors.

    Blocks of queries are dealt to all shards of their length: a stated query
    set against all rows.  A slice of up to about ``SLICE_BLOCKS`` blocks meets
    one copy of a shard's graph, so queries are shuffled once a shard and a graph
    once a slice; a task streams the blocks of its slices.  An empty index or
    query set gives no rows; a repeated query row is answered once.
    """
    spark = index.sparkSession
    blocks = (queries.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).alias("blocks"))
              .withColumn("slices", F.ceil(F.col("blocks") / F.lit(SLICE_BLOCKS)).cast("int")))
    dealt = (queries.join(F.broadcast(blocks), "dim")  # a row per vector length
             .groupBy("dim", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("blocks")).cast("int").alias("block"), "slices")
             .agg(F.collect_list(F.struct("vec_id", "v")).alias("queries")))
    shards = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    key = ["dim", "shard", "slice"]
    wanted = (dealt.join(F.broadcast(shards), "dim")
              .select("dim", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)).alias("shard"),
                      F.pmod("block", "slices").alias("slice"), "queries"))
    offered = (index.drop("shards").join(F.broadcast(blocks), "dim")
               .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("blocks", "slices"))
    # Few bytes, much work: a stated number of partitions keeps slices from being joined into few tasks.
    parts = partitions(spark)
    work = offered.repartition(parts, *key).join(wanted.repartition(parts, *key), key)

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w in pdf.itertuples(index=False):
                yield _answers(w, top, ef)

    found = work.mapInPandas(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


def _answers(w, top: int, ef: int) -> pd.DataFrame:
    vectors = np.frombuffer(w.vectors).reshape(-1, w.dim)
    members = np.frombuffer(w.members, np.int64).reshape(len(vectors), -1)
    graph = Graph(np.frombuffer(w.level, np.float32).reshape(len(vectors), -1),
                  [np.frombuffer(x, np.int32).reshape(-1, n) for x, n in zip(w.links, w.widths)])
    seen, out = np.zeros(len(vectors), np.int32), []
    own: set[int] = set()
    for mark, row in enumerate(sorted(w.queries, key=lambda r: r["vec_id"]), 1):
        if row["vec_id"] in own:
            continue  # a repeated row
        own.add(row["vec_id"])
        q = np.asarray(row["v"], np.float64)
        scaled = np.append(q / np.sqrt(q @ q), 0).astype(np.float32)
        nodes = graph.search(scaled, max(ef, top + 1), seen, mark)
        score = vectors[nodes] @ q
        ids = members[nodes]
        keep = (ids >= 0) & (ids != row["vec_id"])
        score, ids = np.repeat(score, ids.shape[1])[keep.ravel()], ids[keep]
        first = np.lexsort((ids, -score))[:top]
        out.append(pd.DataFrame({"query_id": row["vec_id"], "vec_id": ids[first], "score": score[first]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def q_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return search(build_index(vectors), vectors.where("vec_id % 20 = 0"))
