"""Topics: k-means on sparse TF-IDF rows with transfers, nearest-centroid assignment and a
top-down hierarchy of terms (LDA: ``lda``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.session import cut_lineage, written_table


@F.udf(VectorUDT())
def _sparse(size, entries):
    return Vectors.sparse(size, [(e["i"], e["w"]) for e in entries or []])


def kmeans(points: DataFrame, k: int, max_iter: int = 10, seed: int = 1, docs: DataFrame | None = None,
           transfers: int = 10, starts: int = 1) -> tuple[DataFrame, DataFrame]:
    """k-means on ``(doc_id, term, w)``; returns ``(doc_id, cluster)`` and the
    centres ``(cluster, term, c)`` without their zeros.

    ``points`` holds the terms that a sparsity cut has left, so their number is
    bounded by the cut and the mean text length; the terms are numbered, every
    document becomes one sparse vector, and these are written once.  An
    iteration is one scan that sends k partial sums a task; no point is
    shuffled.  Lloyd's iterations are followed by at most ``transfers`` passes of
    ``transfer``; of several ``starts`` (seeds from ``seed`` on) the one with the
    least within-cluster sum of squares is returned.

    ``docs`` (optional ``doc_id`` table) adds documents with no terms; they go to
    the centre closest to the origin.  No points: every cluster is null."""
    spark = points.sparkSession
    names = [r.term for r in points.select("term").distinct().orderBy("term").collect()]
    if not names:
        empty = (docs if docs is not None else points).select("doc_id").distinct()
        return (empty.withColumn("cluster", F.lit(None).cast("int")),
                spark.createDataFrame([], "cluster int, term string, c double"))
    numbers = spark.createDataFrame(list(enumerate(names)), "i int, term string")
    rows = (points.join(F.broadcast(numbers), "term").groupBy("doc_id")
            .agg(F.array_sort(F.collect_list(F.struct("i", F.col("w").cast("double").alias("w")))).alias("entries")))
    if docs is not None:
        rows = docs.select("doc_id").distinct().join(rows, "doc_id", "left")
    vectors = written_table(rows.select("doc_id", F.col("entries").isNotNull().alias("any"), F.col("entries.i").alias("i"),
                                        F.col("entries.w").alias("w"),
                                        _sparse(F.lit(len(names)), "entries").alias("features")), "kmeans")
    best = None
    for start in range(starts):
        model = KMeans(k=k, maxIter=max_iter, seed=seed + start, featuresCol="features", predictionCol="cluster").fit(
            vectors.where("any"))
        begun = model.transform(vectors.where("any")).select("doc_id", "i", "w", F.col("cluster").cast("int").alias("cluster"))
        found = transfer(begun, len(model.clusterCenters()), len(names), transfers, seed + start)
        if best is None or found[2] < best[2]:
            best = found
    assigned, means, _ = best
    centers = [(c, names[i], float(x)) for c, center in enumerate(means) for i, x in enumerate(center) if x]
    lonely = vectors.where("NOT any").select("doc_id", F.lit(int((means ** 2).sum(1).argmin())).alias("cluster"))
    return (assigned.select("doc_id", "cluster").unionByName(lonely),
            spark.createDataFrame(centers, "cluster int, term string, c double"))


# ------------------------------------------------------ transfers between clusters
HALVINGS = 8  # a pass may apply all of its transfers, a half, a quarter ... or the best one alone


def _sums(rows: DataFrame, k: int, size: int, by: list[str], shape: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of ``(*by, sign, i, w)`` rows, the last of ``by`` a cluster.
    The count is the sum of one more number of each row, a 1."""
    entries = F.arrays_zip(F.concat("i", F.array(F.lit(size))).alias("i"), F.concat("w", F.array(F.lit(1.0))).alias("w"))
    long = rows.select(*by, "sign", F.explode(entries).alias("e"))
    found = long.groupBy(*by, F.col("e.i").alias("i")).agg(F.sum(F.col("sign") * F.col("e.w")).alias("s")).toPandas()
    total = np.zeros(shape + (k, size + 1))
    total[tuple(found[x] for x in [*by, "i"])] = found["s"]
    return total[..., size], total[..., :size]


def transfer(state: DataFrame, k: int, size: int, passes: int = 10, seed: int = 1) -> tuple[DataFrame, np.ndarray, float]:
    """The transfer step of Hartigan and Wong in batches, on ``(doc_id, i, w,
    cluster)`` with a row a document.  Returns the same columns, the cluster
    means and the within-cluster sum of squares.

    A point in a cluster of n points adds n / (n - 1) times its squared distance
    to it, and would add n / (n + 1) times that to another cluster; it is to move
    where the second is less.  Moves made together can cost more than they save,
    so a pass tries all of them, a half, a quarter and so on (by a hash of the
    id) and the best one alone, which always saves, and applies what saves most:
    the sum of squares follows from the clusters' sums and counts, so it is known
    without another look at the points.  It never rises; a pass without moves is
    the end.  Clusters of one point keep it.

    The driver holds (``HALVINGS`` + 1) x k x size sums; points stay in Spark.
    """
    squares = state.agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    n, total = _sums(state.withColumn("sign", F.lit(1.0)), k, size, ["cluster"], ())

    def within(counts, sums) -> float:
        return squares - ((sums ** 2).sum(-1) / np.maximum(counts, 1)).sum(-1)

    cost = float(within(n, total))
    schema = "doc_id {}, i array<int>, w array<double>, cluster int, to int, gain double".format(
        state.schema["doc_id"].dataType.simpleString())
    for turn in range(passes):
        means, counts = total / np.maximum(n, 1)[:, None], n
        moved = written_table(state.mapInPandas(lambda pdfs: (_moves(pdf, means, counts) for pdf in pdfs), schema), "transfers")
        moves = moved.where("to >= 0")
        first = moves.orderBy(F.desc("gain"), "doc_id").select("doc_id").first()
        if first is None:
            break
        drawn = (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(turn)), F.lit(1 << 20)) + 1) / F.lit(float(1 << 20))
        level = F.when(F.col("doc_id").eqNullSafe(F.lit(first.doc_id)), HALVINGS).otherwise(
            F.least(F.floor(-F.log2(drawn)), F.lit(HALVINGS - 1))).cast("int")
        sides = moves.withColumn("level", level).select("level", "i", "w", F.explode(F.array(
            F.struct(F.col("cluster").alias("c"), F.lit(-1.0).alias("sign")),
            F.struct(F.col("to").alias("c"), F.lit(1.0).alias("sign")))).alias("side")).select("level", "i", "w", "side.*")
        dn, dtotal = _sums(sides, k, size, ["level", "c"], (HALVINGS + 1,))
        after_n = n + np.cumsum(dn[::-1], 0)[::-1]           # of the moves from a level on
        after = total + np.cumsum(dtotal[::-1], 0)[::-1]
        costs = within(after_n, after)
        chosen = int(costs.argmin())
        if costs[chosen] >= cost:
            break  # a saving below the rounding of the sums
        n, total, cost = after_n[chosen], after[chosen], float(costs[chosen])
        state = moved.select("doc_id", "i", "w", F.when((F.col("to") >= 0) & (level >= chosen), F.col("to"))
                             .otherwise(F.col("cluster")).alias("cluster"))
    return state, total / np.maximum(n, 1)[:, None], cost


def _moves(pdf: pd.DataFrame, means: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Each document with the cluster it would move to (-1: none) and the saving."""
    k, own, each = len(means), pdf["cluster"].to_numpy(), np.arange(len(pdf))
    row = np.repeat(each, [len(x) for x in pdf["i"]])
    i = np.concatenate([*pdf["i"], np.zeros(0, int)]).astype(int)
    w = np.concatenate([*pdf["w"], np.zeros(0)])
    products = np.stack([np.bincount(row, w * means[c, i], minlength=len(pdf)) for c in range(k)], 1)
    far = np.bincount(row, w * w, minlength=len(pdf))[:, None] - 2 * products + (means ** 2).sum(1)
    far = np.maximum(far, 0)
    stays = np.where(counts[own] > 1, far[each, own] * counts[own] / np.maximum(counts[own] - 1, 1), 0)
    goes = far * counts / (counts + 1)
    goes[each, own] = np.inf
    to = goes.argmin(1)
    gain = stays - goes[each, to]
    found = gain > 1e-9 * (1 + stays)
    return pdf.assign(to=np.where(found, to, -1).astype("int32"), gain=np.where(found, gain, 0.0))


def center_top_terms(centers: DataFrame, n: int) -> DataFrame:
    """Top ``n`` terms of each centre by weight: ``(cluster, rank, term, c)``
    (two-stage top-k, see ``textmining.top_k_per_group``)."""
    from newsfeat.operators.textmining import top_k_per_group
    return top_k_per_group(centers, "cluster", n, "c", "term")


# ------------------------------------------------------------ nearest centre
# Most numbers of all centres together that become part of every task's plan.
MAX_CENTER_NUMBERS = 1_000_000


def group_centroids(df: DataFrame, vec_col: str, label_col: str) -> list[tuple]:
    """``(label, mean vector)`` of each label; equal-length vectors.  One sum a
    label and dimension is shuffled per task; the result is counted before it
    comes to the driver."""
    long = df.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), F.posexplode(vec_col).alias("dim", "x"))
    means = written_table(long.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("c")), "centroids")
    if (found := means.count()) > MAX_CENTER_NUMBERS:
        raise ValueError(f"{found} centre coordinates; at most {MAX_CENTER_NUMBERS} are compared with every row")
    rows = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("v")).orderBy("label").collect()
    return [(r.label, [x["c"] for x in r.v]) for r in rows]


def nearest_centroid(df: DataFrame, id_col: str, vec_col: str, centers: list[tuple]) -> DataFrame:
    """``(id, center, dist)`` - the closest centre by Euclidean distance (ties:
    smallest centre), in one narrow projection.  No centre: null."""
    out = df.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))

    def squared(center: list[float]):
        return F.aggregate(F.zip_with("v", F.lit(center), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    if not centers:
        return out.select("id", F.lit(None).cast("int").alias("center"), F.lit(None).cast("double").alias("dist"))
    best = F.array_min(F.array(*[F.struct(squared(c).alias("d2"), F.lit(label).alias("center")) for label, c in centers]))
    return out.select("id", best.alias("b")).select("id", F.col("b.center").alias("center"), F.sqrt("b.d2").alias("dist"))


# CountVectorizer keeps the top ``vocabSize`` terms; the largest int keeps them all.
NO_VOCAB_CAP = (1 << 31) - 1


# ------------------------------------------------------------ term hierarchy
def column_scaled(points: DataFrame, n_rows: int) -> DataFrame:
    """Divide every feature column by its standard deviation over all ``n_rows``
    rows (zeros included).  Distances after standardising columns equal these
    (centering cancels in differences), so the data stays sparse; a column with
    zero variance is dropped (it would be NaN after standardising)."""
    stats = points.groupBy("feature").agg(F.sum("w").alias("s1"), F.sum(F.col("w") * F.col("w")).alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.lit(float(n_rows))) / F.lit(float(max(n_rows - 1, 1)))
    scale = stats.select("feature", var.alias("var")).where(F.col("var") > 0) \
                 .select("feature", (1.0 / F.sqrt("var")).alias("inv_sd"))
    return points.join(scale, "feature").select("id", "feature", (F.col("w") * F.col("inv_sd")).alias("w"))


# A leaf of at most so many different rows and entries is split to its end by one task.
LOCAL_ROWS, LOCAL_ENTRIES = 4096, 2_000_000


def split_to_the_end(ids, features, w, n, h, iters: int) -> list[tuple[str, str]]:
    """``[(id, path)]`` of one leaf's entries, by the rule of ``bisecting_kmeans``.
    Rows meet as inner products only, so a split costs no pass over the entries."""
    names, row = np.unique(np.asarray(ids, dtype=object), return_inverse=True)
    size = len(names)
    count, order = np.zeros(size), np.zeros(size)
    count[row], order[row] = n, h
    by_feature = np.argsort(pd.factorize(np.asarray(features, dtype=object))[0], kind="stable")
    code = pd.factorize(np.asarray(features, dtype=object))[0][by_feature]
    row, w = row[by_feature], np.asarray(w, dtype=float)[by_feature]
    dots = np.zeros((size, size))
    for r, x in zip(np.split(row, np.flatnonzero(np.diff(code)) + 1), np.split(w, np.flatnonzero(np.diff(code)) + 1)):
        dots[np.ix_(r, r)] += np.outer(x, x)
    own = np.diag(dots).copy()
    out, left = [], [(np.arange(size), "")]
    while left:
        at, path = left.pop()
        if len(at) == 1:
            out.append((names[at[0]], path))
            continue
        s0 = at[np.argmin(order[at])]
        dist = own[at] - 2 * dots[at, s0] + own[s0]
        s1 = at[np.argmax(np.where(at == s0, -np.inf, dist))]
        groups = [np.array([s0]), np.array([s1])]
        child = None
        for _ in range(iters):
            score = []
            for g in groups:
                c = count[g] / count[g].sum()
                to = dots[np.ix_(at, g)] @ c
                score.append(c @ (dots[np.ix_(g, g)] @ c) - 2 * to)
            now = score[1] < score[0]
            if child is not None and (now == child).all():
                break
            child = now
            if child.all() or not child.any():
                break
            groups = [at[~child], at[child]]
        if child.all() or not child.any():
            child = at == s1
        left += [(at[~child], path + "0"), (at[child], path + "1")]
    return out


def bisecting_kmeans(points: DataFrame, levels: int | None = None, iters: int = 5, seed: int = 1,
                     local_rows: int = LOCAL_ROWS, local_entries: int = LOCAL_ENTRIES) -> DataFrame:
    """Top-down hierarchy: every leaf is split in two by Lloyd iterations on its
    own rows until no leaf holds two different rows, or ``levels`` times (a leaf
    of equal rows goes to child 0 then).  ``points`` is ``(id, feature, w)``;
    returns ``(id, path)`` where ``path`` is the string of 0/1 choices from the
    root.  Equal rows are one row with a count, so they share a path.

    Seed 0 of a leaf is its row with the smallest seeded hash, seed 1 the row
    farthest from it; if the iterations leave a child empty, seed 1 is split off
    alone, so each split ends.  All large leaves of a level are split in the same
    jobs (centres keyed by ``(leaf, child)``); a leaf within ``local_rows`` and
    ``local_entries`` is split to its end by one task.  Entries are dealt by
    (id, feature), so a term of many documents is spread."""
    from newsfeat.operators.textmining import top_k_per_group
    entries = cut_lineage(points.groupBy("id", "feature").agg(F.sum(F.col("w").cast("double")).alias("w")))
    written = F.col("w") != 0
    rows = entries.groupBy("id").agg(
        F.count(F.when(written, 1)).alias("m"),
        F.sum(F.when(written, F.xxhash64("feature", "w").cast("decimal(38,0)"))).alias("a"),
        F.bit_xor(F.when(written, F.xxhash64(F.lit(1), "w", "feature"))).alias("b"))
    rows = cut_lineage(rows.withColumn("a", F.coalesce("a", F.lit(0).cast("decimal(38,0)"))).fillna(0, ["b"]))
    units = cut_lineage(rows.groupBy("a", "b", "m").agg(F.min("id").alias("unit"), F.count(F.lit(1)).alias("n")))
    members = rows.join(units, ["a", "b", "m"]).select("id", "unit")
    pts = cut_lineage(entries.join(units.select(F.col("unit").alias("id"), "n"), "id"))
    leaves = cut_lineage(units.select(F.col("unit").alias("id"), "n", "m", F.lit("").alias("leaf"),
                                      F.xxhash64("unit", F.lit(seed)).cast("double").alias("h")))
    level = 0
    while level != levels:
        active = leaves.select("id", "leaf", "n", "h")
        if levels is None:
            sizes = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows"), F.sum("m").alias("entries"))
            large = cut_lineage(sizes.where((F.col("rows") > 1) & ((F.col("rows") > local_rows) | (F.col("entries") > local_entries)))
                                .select("leaf"))
            if large.isEmpty():
                break
            active = active.join(large, "leaf", "left_semi")
        child = _split_leaves(pts, active, iters, top_k_per_group)
        leaves = cut_lineage(leaves.join(child, "id", "left").select(
            "id", "n", "m", F.concat("leaf", F.coalesce(F.col("child").cast("string"), F.lit(""))).alias("leaf"), "h"))
        level += 1
    paths = leaves.select(F.col("id").alias("unit"), F.col("leaf").alias("path"))
    if levels is None:
        def finish(key, group):
            ends = split_to_the_end(group["id"], group["feature"], group["w"], group["n"], group["h"], iters)
            return pd.DataFrame([(i, key[0] + p) for i, p in ends], columns=["unit", "path"])

        alone = leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("rows")).where("rows = 1").select("leaf")
        rest = leaves.join(alone, "leaf", "left_anti").select("id", "leaf", "h")
        ended = pts.join(rest, "id").groupBy("leaf").applyInPandas(finish, paths.select("unit", "path").schema)
        paths = leaves.join(alone, "leaf", "left_semi").select(F.col("id").alias("unit"), F.col("leaf").alias("path")).unionByName(ended)
    return members.join(paths, "unit").select("id", "path")


def _split_leaves(pts: DataFrame, leaves: DataFrame, iters: int, top_k_per_group) -> DataFrame:
    """``(id, child)``: one split of every leaf of ``(id, leaf, n, h)``."""
    at = leaves.select("id", "leaf")
    s0 = cut_lineage(top_k_per_group(leaves.withColumn("__h", -F.col("h")), "leaf", 1, "__h", "id").select("id", "leaf"))
    c0 = pts.join(s0, "id").select("leaf", "feature", F.col("w").alias("c"))
    c0n = c0.groupBy("leaf").agg(F.sum(F.col("c") * F.col("c")).alias("cn"))
    xn = pts.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("xn"))
    dot0 = (pts.join(at, "id").join(c0, ["leaf", "feature"])
               .groupBy("id").agg(F.sum(F.col("w") * F.col("c")).alias("dot")))
    far = (at.join(s0.select("id"), "id", "left_anti").join(xn, "id").join(dot0, "id", "left").join(c0n, "leaf")
             .select("id", "leaf", (F.col("xn") - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("cn")).alias("dist")))
    s1 = cut_lineage(top_k_per_group(far, "leaf", 1, "dist", "id").select("id", "leaf"))
    seeds = s0.withColumn("child", F.lit(0)).unionByName(s1.withColumn("child", F.lit(1)))
    centers = cut_lineage(pts.join(seeds, "id").select("leaf", "child", "feature", F.col("w").alias("c")))
    for _ in range(iters):
        norms = centers.groupBy("leaf").agg(
            F.sum(F.when(F.col("child") == 0, F.col("c") * F.col("c")).otherwise(0.0)).alias("n0"),
            F.sum(F.when(F.col("child") == 1, F.col("c") * F.col("c")).otherwise(0.0)).alias("n1"),
            F.min("child").alias("least"), F.max("child").alias("most"))
        dots = (pts.join(at, "id").join(centers, ["leaf", "feature"])
                   .groupBy("id").agg(
                       F.sum(F.when(F.col("child") == 0, F.col("w") * F.col("c")).otherwise(0.0)).alias("d0"),
                       F.sum(F.when(F.col("child") == 1, F.col("w") * F.col("c")).otherwise(0.0)).alias("d1")))
        nearer = F.when((F.col("n1") - 2 * F.coalesce("d1", F.lit(0.0))) < (F.col("n0") - 2 * F.coalesce("d0", F.lit(0.0))), 1).otherwise(0)
        assign = cut_lineage(leaves.join(dots, "id", "left").join(F.broadcast(norms), "leaf", "left")
                             .select("id", "leaf", "n", F.when(F.col("least") == F.col("most"), F.col("least"))
                                     .otherwise(nearer).alias("child")))
        sizes = assign.groupBy("leaf", "child").agg(F.sum("n").alias("size"))
        centers = cut_lineage(
            pts.drop("n").join(assign, "id").groupBy("leaf", "child", "feature").agg(F.sum(F.col("w") * F.col("n")).alias("s"))
               .join(sizes, ["leaf", "child"]).select("leaf", "child", "feature", (F.col("s") / F.col("size")).alias("c")))
    one = assign.groupBy("leaf").agg((F.min("child") == F.max("child")).alias("one"))
    return (assign.join(one, "leaf").join(s1.select("id", F.lit(1).alias("apart")), "id", "left")
            .select("id", F.when(F.col("one"), F.coalesce("apart", F.lit(0))).otherwise(F.col("child")).alias("child")))
