"""N-gram Jaccard join by T-occurrence search.

Documents are sets of hashed word shingles; two link when the intersection is a
given share of the union.  Exact copies are one class, and classes are searched:

1. A fixed part of all shingles, picked by their hash, is counted over the whole
   corpus.  A class that holds more shingles of its own there than a link may
   leave out can't link (proof, not estimate) and is done.
2. The shingles of the rest are counted in full; those of one class only are
   dropped, the others ordered from rare to frequent.
3. Inverted lists are cut as DivideSkip cuts them: a query's rarest shingles, as
   many as a link may miss and one more, give its short lists, the others are
   the long ones.  The short lists are merged with a heap; ids that occur often
   enough for what the long lists can still add are probed there by binary
   search, and stay if they reach the required overlap.

Classes that link with the first class of a short list are put together before
the search, and lists hold only ids of other components than the query's: a
family of near copies costs one probe a member and list, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import read, utf8
from newsfeat.llm.components import connected_components
from newsfeat.session import written_table

SHINGLE = 4
PERCENT = 85              # of the union, at least
COUNTED = 5               # one shingle in so many is counted over all documents
LIST_ROWS = 4096          # ids of a list that one task merges, about
MAX_BROADCAST_ROWS = 200_000
BITS = 256                # of the bitmaps that bound an overlap

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


# --------------------------------------------------------------------- shingles
def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    ``bytes.lower`` and ``bytes.split`` act on A-Z and the six ASCII space
    characters only.  A text of fewer words is one shingle.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):  # a polynomial over the words, mixed after each
        out = (out ^ hashes[i:len(hashes) - k + 1 + i]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out = out * _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, counted: int) -> DataFrame:
    """``(doc_id, text_hash, n, hi, lo, sample)``, one row per input row: the
    size of its set, 128 bits of it, and the shingles that are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, samples = [], [], []
            for text in batch.column(2):
                own = shingle_hashes(text.as_py(), shingle)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                samples.append(own[own % np.uint64(counted) == 0].view(np.int64))
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]),
                 pa.array(halves[:, 1]), _lists(samples)], names=["doc_id", "text_hash", "n", "hi", "lo", "sample"])

    return _narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, text_hash long, n long, hi long, lo long, sample array<long>")


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                       utf8(text_col).alias("t"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64)))


def _least(n: Column, percent: int) -> Column:
    """The overlap that a set of ``n`` needs with any other one."""
    return F.ceil(n * percent / F.lit(100.0) - 1e-9)


# ----------------------------------------------------------------------- classes
def _classes(signs: DataFrame, percent: int) -> DataFrame:
    """``(cls, hi, lo, n, first, live)``: one row per distinct set, numbered;
    ``live`` if the counted shingles leave room for a link."""
    some = signs.where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # Partial aggregation keeps a shingle's least and greatest owner only.
    alone = (some.select("hi", F.explode("sample").alias("t")).groupBy("t").agg(F.min("hi").alias("a"), F.max("hi").alias("b"))
             .where("a = b").groupBy(F.col("a").alias("hi")).agg(F.count("*").alias("alone")))
    classes = some.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max("n").alias("n"))
    return written_table(
        classes.join(alone, "hi", "left").select(
            F.monotonically_increasing_id().alias("cls"), "hi", "lo", "n", "first",
            (F.coalesce("alone", F.lit(0)) <= F.col("n") - _least(F.col("n"), percent)).alias("live")), "set-classes")


def _live_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(cls, n, shingles)`` of the live classes, from their first documents."""
    live = classes.where("live").select("cls", "n", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("h"))
    if live.count() <= MAX_BROADCAST_ROWS:
        live = F.broadcast(live)
    texts = (_narrow(docs, id_col, text_col)
             .join(live, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("h"))).select("cls", "n", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(own)], names=["cls", "n", "shingles"])

    # Repeated rows have the same id and text; one of them is enough.
    return written_table(texts.mapInArrow(run, "cls long, n long, shingles array<long>").dropDuplicates(["cls"]), "live-sets")


_BITMAP = [f"b{i}" for i in range(BITS // 64)]


def _ordered_sets(sets: DataFrame, percent: int) -> DataFrame:
    """``(cls, n, shared, b0, ..)``: the shingles that other live classes hold
    too, from rare to frequent, where they are enough for a link, and a bitmap of
    them: each shingle flips one bit, so two sets differ in as many shingles as
    bits at least."""
    rows = sets.select("cls", "n", F.explode("shingles").alias("t"))
    common = rows.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    shared = (rows.join(common, "t").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
              .select("cls", "n", F.col("s.t").alias("shared")))  # a list as long as its document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [np.packbits(np.bincount(s.values.to_numpy() & (BITS - 1), minlength=BITS) & 1).view(np.int64)
                    for s in batch.column(2)]
            words = np.array(maps, np.int64).reshape(-1, len(_BITMAP))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(words[:, i]) for i in range(len(_BITMAP)))],
                                             names=["cls", "n", "shared", *_BITMAP])

    enough = shared.where(F.size("shared") >= _least(F.col("n"), percent))
    return written_table(enough.mapInArrow(run, "cls long, n long, shared array<long>, " + ", ".join(f"{b} long" for b in _BITMAP)),
                         "ordered-sets")


# ------------------------------------------------------------------------ search
def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` that link: the shingles of one are probed in
    the sorted ones of the other by binary search."""
    one = sets.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    two = sets.select(F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, s_a, s_b in zip(*(batch.column(i) for i in range(2, 6))):
                list_, probes = np.sort(s_a.values.to_numpy()), s_b.values.to_numpy()
                found = list_[np.minimum(np.searchsorted(list_, probes), len(list_) - 1)] == probes
                both = int(found.sum())
                keep.append(100 * both >= percent * (n_a.as_py() + n_b.as_py() - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return met.mapInArrow(probe, "a long, b long")


def _routes(sets: DataFrame, percent: int) -> DataFrame:
    """``(t, cls, n, alone, pos, index)`` and the bitmap: each class at the shingles
    of its short lists; ``index`` marks those that are enough as the smaller set
    of a pair.  ``alone`` counts the shingles of the class alone, which come
    first, and ``pos`` all before this one."""
    n, alone = F.col("n"), F.col("n") - F.size("shared")
    probe = (n - _least(n, percent) + 1 - alone).cast("int")
    # The smaller set of a pair shares 2p / (1 + p) of itself.
    index = n - F.ceil(n * (2 * percent) / F.lit(100.0 + percent) - 1e-9) + 1
    return (sets.select("cls", "n", alone.cast("long").alias("alone"), index.alias("upto"), *_BITMAP,
                        F.posexplode(F.slice("shared", F.lit(1), probe)).alias("i", "t"))
            .select("t", "cls", "n", "alone", (F.col("i") + F.col("alone")).alias("pos"),
                    (F.col("i") + F.col("alone") < F.col("upto")).alias("index"), *_BITMAP))


def _star_pairs(routes: DataFrame, percent: int) -> DataFrame:
    """Each class with the first class of each of its short lists."""
    heads = (routes.groupBy("t").agg(F.min(F.struct("cls", "n")).alias("head"), F.max("cls").alias("most"))
             .where("head.cls < most").select("t", F.col("head.cls").alias("a"), F.col("head.n").alias("n_a")))
    return (routes.join(heads, "t").where("cls <> a")
            .where((F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent))
            .select("a", F.col("cls").alias("b")).distinct())


def _candidates(routes: DataFrame, components: DataFrame, percent: int, list_rows: int) -> DataFrame:
    """``(a, b)`` of different components that occur together often enough: the
    short lists of each query, split by a hash of their ids if they are long,
    merged with a heap."""
    named = routes.join(components.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn(
        "comp", F.coalesce("root", "cls")).drop("root")
    named = written_table(named, "routes")
    owners = named.groupBy("t", "comp").agg(F.count("*").alias("rows"))
    mixed = written_table(owners.groupBy("t").agg(F.max_by("comp", "rows").alias("main"), F.count("*").alias("comps"),
                                                  F.sum("rows").alias("rows")).where("comps > 1"), "mixed-lists")
    longest = mixed.agg(F.max("rows")).first()[0] or 0
    splits = max(1, -(-longest // list_rows))
    kept = named.join(mixed.select("t", "main"), "t").withColumn("in_main", F.col("comp") == F.col("main"))
    entry = ["cls", "n", "alone", "pos", "comp", *_BITMAP]
    lists = (kept.where("index").withColumn("split", F.pmod(F.xxhash64("cls"), F.lit(splits)))
             .groupBy("t", "in_main", "split").agg(F.sort_array(F.collect_list(F.struct(*entry))).alias("ids")))
    queries = kept.select("t", F.struct(*entry[:3], *entry[4:]).alias("q"), F.col("pos").alias("q_pos"),
                          F.col("in_main").alias("q_main"))
    # Lists of the main component are of no use to its own members.
    met = (queries.join(lists, "t").where("NOT (in_main AND q_main)")
           .groupBy("q", "split").agg(F.collect_list(F.struct("q_pos", "ids")).alias("lists")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for query, lists in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = t_occurrence(query, lists.values, percent)
                out_a += found
                out_b += [query["cls"]] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return met.select("q", "lists").mapInArrow(search, "a long, b long")


def t_occurrence(query: dict, lists: pa.StructArray, percent: int) -> list[int]:
    """Ids of the short lists that the long ones can still lift to the required
    overlap.

    An id of the query's own component, of a larger set, or of one that differs
    in too many shingles by the bitmaps is passed over.  The lists are merged
    with a heap; an id's bound are its occurrences so far and what is left behind
    the last one in the shorter remainder of both sets.
    """
    size, own = query["n"], (query["n"], query["cls"])
    q_bits = np.array([query[b] for b in _BITMAP], np.int64)
    shortened = []
    for one in range(len(lists)):
        ids = lists.field("ids")[one].values
        of = {f: ids.field(f).to_numpy(zero_copy_only=False) for f in ("cls", "n", "alone", "pos", "comp")}
        differ = of["alone"] + query["alone"]
        for i, b in enumerate(_BITMAP):
            differ = differ + np.bitwise_count((ids.field(b).to_numpy(zero_copy_only=False) ^ q_bits[i]).view(np.uint64))
        n, cls = of["n"], of["cls"]
        keep = ((of["comp"] != query["comp"]) & ((n < size) | (n == size) & (cls < own[1])) & (100 * n >= percent * size)
                & ((n + size - differ) // 2 * (100 + percent) >= percent * (n + size)))
        at = lists.field("q_pos")[one].as_py()
        shortened.append([(c, m, at, p) for c, m, p in zip(cls[keep].tolist(), n[keep].tolist(), of["pos"][keep].tolist())])
    found, now, n, count, rest = [], None, 0, 0, 0
    for cls, m, q_pos, pos in merge(*shortened):
        if cls != now:
            if now is not None and _enough(count + rest, n, size, percent):
                found.append(now)
            now, n, count, rest = cls, m, 0, size
        count += 1
        rest = min(rest, size - q_pos - 1, m - pos - 1)
    if now is not None and _enough(count + rest, n, size, percent):
        found.append(now)
    return found


def _enough(overlap: int, a: int, b: int, percent: int) -> bool:
    return overlap * (100 + percent) >= percent * (a + b)


# ---------------------------------------------------------------------- operator
def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT, counted: int = COUNTED, list_rows: int = LIST_ROWS) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, component_id)``, one row per input row.

    Null texts and texts without words have no shingles and link with nothing;
    equal sets always link.  Rows with a null id take part and get the smallest
    id that is reached (null if there is none); rows that share an id are rows of
    their own; repeated rows come back as often as they came; other columns are
    not read; an empty table gives no rows.
    """
    signs = written_table(signatures(docs, id_col, text_col, shingle, counted), "signatures")
    classes = _classes(signs, percent)
    sets = _ordered_sets(_live_sets(docs, classes, id_col, text_col, shingle), percent)
    routes = written_table(_routes(sets, percent), "short-lists")
    stars = written_table(_linked(_star_pairs(routes, percent), sets, percent), "star-links")
    near = connected_components(stars)
    rest = _linked(_candidates(routes, near, percent, list_rows), sets, percent)
    links = near.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)
    roots = connected_components(links).withColumnRenamed("node", "cls")
    rooted = classes.join(roots, "cls").select("cls", "root", "first")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = rooted.join(lowest, "root").select("cls", "lowest")
    # Written, so that the join with all rows stands alone and a hot class is split.
    named = written_table(classes.join(linked, "cls", "left").select("hi", "lo", F.coalesce("lowest", "first").alias("lowest")),
                          "set-components")
    with_words = signs.where("n > 0").select("doc_id", "text_hash", "n", "hi", "lo").join(named, ["hi", "lo"]).select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("lowest.doc_id").alias("component_id"))
    without = signs.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without)


def q_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


# DuckDB's form: all pairs that share a shingle.
SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END) AS shingle
      FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)"""
