"""Periodic runs of words by an online sparse diagonal recurrence.

For each word of a text its earlier occurrences name the lags at which the text
repeats; a lag that was matched at the word before too grows by one, others
start at one, and a lag that isn't matched any more ends and emits its run if it
is long enough.  Only the lags of the word before are held.

Two exact cuts keep the state small.  A run of period p that covers r periods
makes at least (r - 1) * p words in a row whose last occurrence is p words back
at most; words outside such stretches are never looked at.  And while the text
has a period q over q + m words, the lags between q and m say nothing new: by
the periodicity lemma a run of such a lag would be one of period q, or has
matched fewer than q words, which are counted again when the period q ends.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import read, utf8

MIN_LENGTH = 6        # words of a run at least
REPEATS = 4           # periods of a run at least
BYTES_AT_ONCE = 4 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _stretches(words: list[bytes], repeats: int) -> Iterator[tuple[int, int]]:
    """(first, end) of the word ranges outside of which no run can match a lag."""
    last: dict[bytes, int] = {}
    lags, ranges, begin = [], [], None
    for i, word in enumerate(words):
        before = last.get(word)
        last[word] = i
        if before is None:
            lags.append(0)
            if begin is not None:
                ranges.append((begin, i))
                begin = None
        else:
            lags.append(i - before)
            if begin is None:
                begin = i
    if begin is not None:
        ranges.append((begin, len(words)))
    for first, end in ranges:
        most = (end - first) // (repeats - 1)
        for i in range(first, end):
            if lags[i] > most:
                if i > first:
                    yield first, i
                first = i + 1
        if end > first:
            yield first, end


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    ``period`` is the smallest one, and a run has ``min_length`` words and
    ``repeats`` periods at least (``repeats`` > 1).
    """
    found: dict[tuple[int, int], int] = {}
    for first, end in _stretches(words, repeats):
        for start, length, period in _diagonals(words, first, end, min_length, repeats):
            found[start, length] = min(period, found.get((start, length), period))
    return sorted((start, length, period) for (start, length), period in found.items())


def _diagonals(words: list[bytes], first: int, end: int, min_length: int,
               repeats: int) -> Iterator[tuple[int, int, int]]:
    most = (end - first) // (repeats - 1)  # the longest period that fits
    if most == 0 or end - first < min(max(min_length - p, (repeats - 1) * p) for p in range(1, min(most, min_length) + 1)):
        return
    at: dict[bytes, list[int]] = {}
    for i in range(max(0, first - most), first):
        at.setdefault(words[i], []).append(i)
    active: dict[int, int] = {}             # lag -> words matched up to the one before
    zones: list[tuple[int, int]] = []       # (period, matched words) that hide the lags between them
    for i in range(first, end):
        occurrences = at.setdefault(words[i], [])
        now: dict[int, int] = {}
        hidden: list[tuple[int, int]] = []
        k = len(occurrences) - 1
        while k >= 0 and i - occurrences[k] <= most:
            lag = i - occurrences[k]
            matched = active.get(lag)
            if matched is None:
                matched = 0
                if any(q < lag <= m for q, m in zones):  # was hidden: count again
                    while i - matched > first and words[i - matched - 1] == words[i - matched - 1 - lag]:
                        matched += 1
            now[lag] = matched + 1
            k -= 1
            if matched + 1 > lag:
                hidden.append((lag, matched + 1))
                k = bisect_left(occurrences, i - matched - 1, 0, k + 1) - 1
        for lag, matched in active.items():
            if lag not in now and matched >= (repeats - 1) * lag and matched + lag >= min_length \
                    and not any(q < lag <= m for q, m in hidden):
                yield i - matched - lag, matched + lag, lag
        occurrences.append(i)
        active, zones = now, hidden
    for lag, matched in active.items():
        if matched >= (repeats - 1) * lag and matched + lag >= min_length:
            yield end - matched - lag, matched + lag, lag


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    kept, at = [], 0
    for first, last in sorted((start + period, start + length) for start, length, period in runs):
        if last > at:
            kept += words[at:max(at, first)]
            at = last
    return kept + words[at:]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                  repeats: int = REPEATS) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row per input row: the runs by
    start, then period, and the text of the words that no run repeats, joined by
    one space.

    A narrow step without a shuffle.  Null and empty texts have no words and no
    runs; repeated rows come back as often as they came, rows with a null id
    too; other columns are not read; an empty table gives no rows; bytes that are
    no UTF-8 count as U+FFFD in ``collapsed``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, runs, texts, size = [], [], [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = text.as_py().split()
                own = runs_of(words, min_length, repeats)
                ids.append(doc_id.as_py())
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(collapsed(words, own)).decode("utf-8", "replace"))
                size += len(texts[-1]) + 32 * len(own)
                if size > BYTES_AT_ONCE:
                    yield _batch(ids, counts, runs, texts)
                    ids, counts, runs, texts, size = [], [], [], [], 0
            yield _batch(ids, counts, runs, texts)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return narrow.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def _batch(ids: list, counts: list, runs: list, texts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"])


def with_repeated_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which one text in ten, chosen by the crc32 of its id, ends in a
    repeated stretch of its own words: with g a tenth of that number, from word
    a = g mod n on, the 1 + floor((n - a) / (3 + g mod 8)) words there repeat to
    the end.  Texts without words and rows without an id stay as they are.

    Only the changed texts are cut into words; slices and repeats of the word
    array build them, no function per word.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.col("__n")
    a, p = F.col("__a"), F.col("__p")
    columns = docs.columns

    def longs(c: Column) -> Column:
        return F.floor(c).cast("int")

    chosen = (h % 10 == 0) & F.col(text_col).isNotNull()
    cut = (docs.withColumn("__w", F.when(chosen, words))
           .withColumn("__n", F.size(F.coalesce("__w", F.array().cast("array<string>"))))
           .withColumn("__a", F.when(n > 0, (g % n).cast("int")))
           .withColumn("__p", F.when(n > 0, 1 + longs((n - a) / (3 + g % 8)))))
    tail = F.flatten(F.array_repeat(F.slice("__w", a + 1, p), longs((n - a) / p) + 1))
    text = F.array_join(F.slice(F.concat(F.slice("__w", F.lit(1), a), tail), F.lit(1), n), " ")
    return cut.withColumn(text_col, F.when(n > 0, text).otherwise(F.col(text_col))).select(*columns)


def q_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_repeated_tails(read(spark, sf_dir, "documents").select("doc_id", "text"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = periodic_runs(docs).withColumn("longest", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"),
        F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256)
        .alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
