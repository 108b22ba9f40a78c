"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target of words and a weight schedule over training time
0..1.  The schedule's integral, scaled to the target, is the source's cumulative
demand; a document's place in its source's stream, put through the inverse of
that curve, is its training position.  A range sort by position gives the order
in which documents are read.

Prefix sums inside a source come from two levels: sums per (source, hash
bucket), and a running sum within one bucket.  Buckets hold about BUCKET_ROWS
rows whatever the table's size, so a source with a third of all rows is spread
like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsfeat.llm.common import WORD, read

WEIGHTS = (3.0, 1.0, 2.0)   # of the sources by code point, repeating
SHARE = 1.5                 # words of the mix per word of the sources
MAX_REPEAT = 2              # a source is read so many times at most
SEED = "curriculum-1"       # of the order within a source
BUCKET_ROWS = 500
# Weight schedules of the sources by code point, repeating: (time, weight) knots,
# linear in between.
SCHEDULES = (
    ((0.0, 1.0), (0.5, 2.0), (1.0, 1.0)),
    ((0.0, 3.0), (1.0, 1.0)),
    ((0.0, 1.0), (0.7, 1.0), (1.0, 4.0)),
)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def areas(schedule) -> list[float]:
    """The schedule's integral from time 0 up to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def position(share: Column, schedule) -> Column:
    """Time at which a source has met ``share`` (0..1) of its demand: the inverse
    of the schedule's normalised integral, a root of a quadratic per segment."""
    upto, out = areas(schedule), None
    area = share * upto[-1]
    for (t0, w0), (t1, w1), below in reversed(list(zip(schedule, schedule[1:], upto))):
        slope = (w1 - w0) / (t1 - t0)
        rest = area - below
        root = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * rest)) - w0) / slope
        out = t0 + root if out is None else F.when(area < below + _area(t0, w0, t1, w1), t0 + root).otherwise(out)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), out))


def _area(t0, w0, t1, w1) -> float:
    return (t1 - t0) * (w0 + w1) / 2


def source_targets(sums: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``__place`` and ``target`` to ``(source, source_size)``.

    Sources sorted by cap per weight fill up one after the other: a source is
    capped if the words left, shared by weight among it and the sources after
    it, would exceed its cap.  The windows run over the table of sources (one
    row each), not over documents.
    """
    placed = sums.withColumn("__place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("__place", F.lit(len(weights))).cast("int") + 1)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "__place")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    left = (placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
            .withColumn("words_left", share * F.sum("source_size").over(everything)
                        - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("weight_left", F.sum("weight").over(everything)
                        - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", F.col("words_left") / F.col("weight_left"))
            .withColumn("free", F.col("level") * F.col("weight") < F.col("cap")))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(
        by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return left.withColumn("target", F.when(F.col("free"), level * F.col("weight")).otherwise(F.col("cap").cast("double"))
                           ).select("source", "source_size", "target", "__place")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             size: Column | None = None, keep_text: bool = True, weights=WEIGHTS, schedules=SCHEDULES,
             share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Rows of ``docs`` with a struct ``__mix``: ``size``, ``source_size``,
    ``target``, ``taken`` and ``copies``, an array of (epoch, words, position)
    of the copies that the mix reads.

    A source's stream repeats its documents in the order of a seeded digest of
    their ids (ties: digest of the text); the mix reads its first ``target``
    words (rounded), so the last copy may be taken in part.  Null text has size
    0, null source is a source of its own, the last one; repeated rows are
    rows of their own; empty texts and an empty table take nothing.
    """
    cut = max(1, math.ceil(math.log(max(docs.count(), 1) / BUCKET_ROWS + 1, 16)))
    keyed = (docs.withColumn("__size", word_count(text_col) if size is None else size)
             .withColumn("__order", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")))
             .withColumn("__tie", F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
             .withColumn("__source", F.coalesce(F.concat(F.lit("="), source_col), F.lit("")))
             .withColumn("__bucket", F.substring("__order", 1, cut)))
    sums = keyed.groupBy(F.col(source_col).alias("source"), "__source", "__bucket").agg(F.sum("__size").alias("words"))
    per_source = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(per_source, weights, share, max_repeat).withColumn(
        "__source", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    upto = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sums.select("__source", "__bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("__offset"))
               .join(targets.withColumnsRenamed({"source_size": "__source_size", "target": "__target"}), "__source"))
    rows = keyed if keep_text else keyed.drop(text_col)
    inside = Window.partitionBy("__source", "__bucket").orderBy("__order", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.join(offsets, ["__source", "__bucket"])
              .withColumn("__start", F.col("__offset") + F.coalesce(F.sum("__size").over(inside), F.lit(0))))
    wanted = F.floor(F.col("__target") + 0.5)

    def copy(epoch: Column) -> Column:
        start = F.col("__start") + epoch * F.col("__source_size")
        words = F.least(F.col("__size"), F.greatest(F.lit(0), wanted - start))
        share_met = start / F.greatest(wanted, F.lit(1))
        at = position(share_met, schedules[0])
        for i, schedule in enumerate(schedules[1:], 1):
            at = F.when(F.pmod("__place", F.lit(len(schedules))) == i, position(share_met, schedule)).otherwise(at)
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), at.alias("position"))

    copies = F.filter(F.transform(F.array(*[F.lit(e) for e in range(max_repeat)]), copy), lambda c: c.words > 0)
    mix = F.struct(F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                   F.col("__target").alias("target"),
                   F.aggregate(copies, F.lit(0).cast("long"), lambda a, c: a + c.words).alias("taken"),
                   copies.alias("copies"))
    columns = [c for c in docs.columns if keep_text or c != text_col]
    return placed.withColumn("__mix", mix).select(*columns, "__mix")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in training order, as often as the mix reads them,
    with the columns of ``docs`` only.

    The sort is a range sort by training position (ties by id, then epoch).  A
    copy that the mix takes in part is read whole if at least half of it is
    taken, so whole documents come out and a source misses its target by half a
    document at most.
    """
    planned = mix_plan(docs, **options)
    copies = planned.withColumn("__copy", F.explode_outer("__mix.copies")).where("2 * __copy.words >= __mix.size")
    return (copies.orderBy("__copy.position", options.get("id_col", "doc_id"), "__copy.epoch")
            .select(*docs.columns))


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned = mix_plan(docs, keep_text=False)
    return (planned.select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken",
                           F.round(F.try_element_at("__mix.copies", F.lit(1)).position, 9).alias("first_position"))
            .orderBy("first_position", "doc_id"))


def _sql_position(schedule) -> str:
    """DuckDB's form of ``position`` for a column ``met``."""
    upto, out = areas(schedule), ""
    for i, ((t0, w0), (t1, w1), below) in enumerate(zip(schedule, schedule[1:], upto)):
        slope = (w1 - w0) / (t1 - t0)
        rest = f"(met * {upto[-1]!r} - {below!r})"
        root = f"{rest} / {w0!r}" if slope == 0 else f"(sqrt(greatest(0.0, {w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {rest})) - {w0!r}) / {slope!r}"
        last = i == len(schedule) - 2
        out += f"ELSE {t0!r} + {root} " if last else f"WHEN met * {upto[-1]!r} < {below + _area(t0, w0, t1, w1)!r} THEN {t0!r} + {root} "
    return f"least(1.0, greatest(0.0, {'CASE ' + out + 'END' if len(schedule) > 2 else out.removeprefix('ELSE ')}))"


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS o, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
      FROM d GROUP BY source),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size * {MAX_REPEAT} AS cap FROM s),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS lev
      FROM w WINDOW p AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lev * weight < cap AS free FROM l),
t AS (SELECT source, source_size, place, CASE WHEN free THEN weight * (
          SELECT arg_min(lev, cap / weight) FROM f WHERE free) ELSE cap::DOUBLE END AS target FROM f),
c AS (SELECT d.*, source_size, target, place, floor(target + 0.5)::BIGINT AS wanted,
             (sum(size) OVER (PARTITION BY d.source ORDER BY o, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, start::DOUBLE / greatest(wanted, 1) AS met FROM c)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, wanted - start)) + least(size, greatest(0, wanted - start - source_size)))::BIGINT AS taken,
       round(CASE WHEN least(size, wanted - start) > 0 THEN CASE place % 3
         WHEN 0 THEN {_sql_position(SCHEDULES[0])}
         WHEN 1 THEN {_sql_position(SCHEDULES[1])}
         ELSE {_sql_position(SCHEDULES[2])} END END, 9) AS first_position
FROM m"""
