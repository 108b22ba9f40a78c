"""Removal of repeated multi-line chunks.

A rolling hash over the hashes of neighbouring lines decides where a chunk
ends, so the same run of lines is cut alike wherever it stands in a document.
Chunks of two or more written lines that occur more than once in the corpus
keep their first occurrence; equal hashes are believed only after a comparison
of bytes.

Chunks meet only where boundaries fall alike, so most short repeated runs stay.
``runs=True`` takes a chunk from every written line on instead (as many lines as
``min_lines`` asks for): each repeated run is covered by such chunks whatever
stands around it, and what is cut is their union.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import read
from newsfeat.session import written_table

PRIME = 2_147_483_647   # 2^31 - 1: products of two remainders fit a long
BASE = 1_000_003
WINDOW = 2              # lines whose hashes a boundary depends on
EVERY = 3               # lines per chunk on average
MIN_LINES = 2           # written (non-blank) lines of a chunk that may be removed


def line_hashes(lines: Column) -> Column:
    """28 bits of each line's digest."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("long"))


def rolling(hashes: Column, window: int = WINDOW) -> Column:
    """Polynomial hash of each line and the ``window - 1`` lines before it."""
    def at(_, i: Column) -> Column:
        out = F.lit(0).cast("long")
        for back in range(window - 1, -1, -1):
            out = F.pmod(out * BASE + F.coalesce(F.get(hashes, i - back), F.lit(0)), F.lit(PRIME))
        return out
    return F.transform(hashes, at)


def with_chunks(df: DataFrame, text_col: str, window: int = WINDOW, every: int = EVERY) -> DataFrame:
    """Adds ``__lines`` and ``__chunks``, an array of (first, last) line numbers
    from 0.  Staged columns keep each array evaluated once."""
    return (df.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
            .withColumn("__hashes", line_hashes(F.col("__lines")))
            .withColumn("__rolled", rolling(F.col("__hashes"), window))
            .withColumn("__ends", F.filter(F.transform("__rolled", lambda r, i: F.when(
                (F.pmod(r, F.lit(every)) == 0) | (i == F.size("__lines") - 1), i)), lambda i: i.isNotNull()))
            .withColumn("__chunks", F.transform("__ends", lambda e, k: F.struct(
                F.coalesce(F.get("__ends", k - 1) + 1, F.lit(0)).alias("first"), e.alias("last"))))
            .drop("__hashes", "__rolled", "__ends"))


def narrow_docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def run_rows(docs: DataFrame, id_col: str, text_col: str, min_lines: int) -> DataFrame:
    """As ``chunk_rows``, of the chunks that reach from each written line to the
    ``min_lines - 1``-th written line after it, blank lines between included.
    Staged as there: lines and line numbers are each named twice."""
    narrow = narrow_docs(docs, id_col, text_col)
    lined = (narrow.where(F.contains("text", F.lit("\n")))
             .select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n", -1).alias("__lines"))
             .withColumn("__written", F.filter(F.transform("__lines", lambda x, i: F.when(F.trim(x) != "", i)),
                                               lambda i: i.isNotNull())))

    def piece(first: Column, k: Column) -> Column:
        last = F.get("__written", k + (min_lines - 1))
        return F.when(last.isNotNull(), F.struct(first.alias("first"), last.alias("last"), F.array_join(
            F.slice("__lines", first + 1, last - first + 1), "\n").alias("chunk")))

    return (lined.select("doc_id", "text_hash", F.transform("__written", piece).alias("__pieces"))
            .select("doc_id", "text_hash", F.explode_outer("__pieces").alias("c")).where("c IS NOT NULL")
            .select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "c.first", "c.last", "c.chunk")
            .withColumn("h", F.xxhash64("chunk")))


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, window: int, every: int, min_lines: int) -> DataFrame:
    """``(no_id, doc_id, text_hash, first, last, chunk, h)`` of chunks with enough
    written lines.  Chunk texts are cut out before the rows are multiplied, so a
    long text is not copied for each of its chunks; the outer form of explode
    keeps the optimizer from evaluating them a second time in a filter below."""
    narrow = narrow_docs(docs, id_col, text_col)
    chunked = with_chunks(narrow.where(F.contains("text", F.lit("\n"))), "text", window, every)

    def piece(c: Column) -> Column:
        own = F.slice("__lines", c["first"] + 1, c["last"] - c["first"] + 1)
        return F.struct(c["first"].alias("first"), c["last"].alias("last"), F.array_join(own, "\n").alias("chunk"),
                        F.size(F.filter(own, lambda x: F.trim(x) != "")).alias("written"))

    long_enough = F.filter("__chunks", lambda c: c["last"] - c["first"] + 1 >= min_lines)
    return (chunked.select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(long_enough, piece).alias("__pieces"))
            .select("doc_id", "text_hash", F.explode_outer("__pieces").alias("c"))
            .where(F.col("c.written") >= min_lines)
            .select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "c.first", "c.last", "c.chunk")
            .withColumn("h", F.xxhash64("chunk")))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
            every: int = EVERY, min_lines: int = MIN_LINES, runs: bool = False) -> DataFrame:
    """``(doc_id, text_hash, first, last)``: the repeated chunks to remove.
    With ``runs`` they overlap; one that overlaps its own first occurrence loses
    the lines it shares with it.

    One pre-aggregated pass keeps each hash's count, first place and its least
    and greatest bytes: if these two are equal, all chunks of the hash are.
    Hashes for which they differ are grouped by the bytes themselves.
    """
    rows = run_rows(docs, id_col, text_col, min_lines) if runs else chunk_rows(docs, id_col, text_col, window, every, min_lines)
    place = F.struct("no_id", "doc_id", "text_hash", "first")
    # Equal chunks have as many lines, so the first one ends at kept.first + last - first.
    kept_last = F.col("kept.first") + F.col("last") - F.col("first")
    begin = (F.when(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash")),
                    F.greatest("first", kept_last + 1)).otherwise(F.col("first"))) if runs else F.col("first")
    cut = ["doc_id", "text_hash", begin.alias("first"), "last"]
    groups = written_table(
        rows.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("kept"),
                              F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .where("n > 1").select("h", "kept", (F.col("low") != F.col("high")).alias("collides")), "line-chunks")
    occurs = rows.drop("chunk").join(groups.where("NOT collides").drop("collides"), "h")
    found = occurs.where(place != F.col("kept")).select(*cut)
    if not groups.where("collides").isEmpty():
        apart = rows.join(groups.where("collides").select("h"), "h", "left_semi")
        kept = apart.groupBy("chunk").agg(F.min(place).alias("kept"))
        found = found.unionByName(apart.join(kept, "chunk").where(place != F.col("kept")).select(*cut))
    return found


def merged(cuts: str) -> Callable[[DataFrame], DataFrame]:
    """Cuts that may overlap or touch, as the fewest (first, last) in order."""
    def apply(df: DataFrame) -> DataFrame:
        numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(cuts, lambda c: F.sequence(c["first"], c["last"])))))
        return (df.withColumn("__n", numbers)
                .withColumn("__from", F.filter("__n", lambda x, i: ~F.get("__n", i - 1).eqNullSafe(x - 1)))
                .withColumn("__to", F.filter("__n", lambda x, i: ~F.get("__n", i + 1).eqNullSafe(x + 1)))
                .withColumn(cuts, F.transform("__from", lambda x, i: F.struct(x.alias("first"), F.get("__to", i).alias("last"))))
                .drop("__n", "__from", "__to"))
    return apply


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               every: int = EVERY, min_lines: int = MIN_LINES, removed_col: str | None = None, runs: bool = False) -> DataFrame:
    """``docs`` with repeated multi-line chunks cut out of the text; every row
    stays.  ``removed_col`` adds the cut (first, last) line numbers; a column
    ``n_chars`` is counted anew.  ``runs`` finds every repeated run of
    ``min_lines`` written lines or more (``window`` and ``every`` are not used).

    First means the smallest id (null last), then the text's hash, then the
    line.  Rows with the same id and text count as one document; null texts
    stay null, empty tables empty; blank lines alone never make a chunk.
    """
    cuts = (repeats(docs, id_col, text_col, window, every, min_lines, runs)
            .groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
            .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__cuts")))
    if runs:
        cuts = cuts.transform(merged("__cuts"))
    joined = docs.join(cuts, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                       & (F.xxhash64(text_col) == F.col("__hash")), "left")
    # Lines between the cuts; the lines are named twice, so the split is a column of its own.
    lined = joined.withColumn("__lines", F.split(F.col(text_col), "\n", -1))

    def between(k: Column) -> Column:
        start = F.coalesce(F.get("__cuts", k - 1)["last"] + 1, F.lit(0))
        end = F.coalesce(F.get("__cuts", k)["first"], F.size("__lines"))
        return F.slice("__lines", start + 1, end - start)

    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__cuts")), between))
    out = lined.withColumn("__text", F.when(F.col("__cuts").isNotNull(), F.array_join(rest, "\n"))
                           .otherwise(F.col(text_col))).drop(text_col).withColumnRenamed("__text", text_col)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cuts").isNotNull(), F.length(text_col).cast("long"))
                             .otherwise(F.col("n_chars")))
    columns = [F.col(c) for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce("__cuts", F.array().cast("array<struct<first:int,last:int>>")).alias(removed_col))
    return out.select(*columns)


def q_line_dedup(spark: SparkSession, sf_dir: str, runs: bool = False) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return (line_dedup(docs, removed_col="removed", runs=runs)
            .withColumn("removed_lines", F.aggregate("removed", F.lit(0), lambda a, c: a + c["last"] - c["first"] + 1))
            .select("doc_id", "text", F.to_json("removed").alias("removed"), "removed_lines"))


def q_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_line_dedup(spark, sf_dir, runs=True)


SQL = f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, ('0x' || left(md5(line), 7))::BIGINT AS lh FROM l),
r AS (SELECT *, ((coalesce(lag(lh) OVER w, 0) % {PRIME}) * {BASE} + lh) % {PRIME} AS roll,
             count(*) OVER (PARTITION BY doc_id) AS n FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum((roll % {EVERY} = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c AS (SELECT doc_id, k, min(i) AS "first", max(i) AS "last", string_agg(line, chr(10) ORDER BY i) AS chunk,
             sum((trim(line, ' ') <> '')::INT) AS written FROM k GROUP BY doc_id, k),
x AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, "first") AS nth FROM c WHERE written >= {MIN_LINES}),
cut AS (SELECT doc_id, k, "first", "last" FROM x WHERE nth > 1),
kept AS (SELECT k.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (cut.doc_id IS NULL) AS text
         FROM k LEFT JOIN cut ON k.doc_id = cut.doc_id AND k.k = cut.k GROUP BY k.doc_id),
cuts AS (SELECT doc_id, '[' || string_agg('{{"first":' || "first" || ',"last":' || "last" || '}}', ',' ORDER BY "first") || ']' AS removed,
                sum("last" - "first" + 1)::INT AS removed_lines FROM cut GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(removed, '[]') AS removed, coalesce(removed_lines, 0)::INT AS removed_lines
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cuts USING (doc_id)"""
