"""Counts of the n-grams that survive the sparsity cut, without forming the rest.

An n-gram is in no more documents than any of its parts, so one above the cut
consists of tokens and shorter n-grams above it.  Level by level, only n-grams
whose two parts of one token less are kept are counted: the tokens first, as text;
from then on each document is a list of token numbers and an n-gram a pair of
numbers.  Spark deals the documents and adds up the counts; a task looks at a
batch at a time.  What is kept is bounded by the cut and the mean text length, and
counted before it comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.session import written_table

STEP_TOKENS = 500_000  # tokens of the documents looked at together, about


def _parts(batches, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """Runs of whole rows of at most ``STEP_TOKENS`` tokens (or one row), the row
    number of each token and the tokens."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, before + STEP_TOKENS, "right")))
            part = batch.slice(first, end - first)
            rows = np.repeat(np.arange(end - first), np.diff(np.r_[before, ends[first:end]]))
            yield part, rows, part.column(column).flatten()
            first = end


def _inside(rows: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram that begins at each token ends in the same row."""
    out = np.zeros(len(rows), bool)
    if len(rows) >= n:
        out[:len(rows) - n + 1] = rows[:len(rows) - n + 1] == rows[n - 1:]
    return out


def _pairs(ids: np.ndarray, rows: np.ndarray, n: int, size: int) -> np.ndarray:
    """The pair number of the n-gram at each token, from the numbers of its two
    parts (``size`` there are); -1 where one isn't kept or the row ends."""
    out = np.full(len(ids), -1, np.int64)
    if len(ids) > 1:
        both = (ids[:-1] >= 0) & (ids[1:] >= 0) & _inside(rows, n)[:-1]
        out[:-1] = np.where(both, ids[:-1] * size + ids[1:], -1)
    return out


def _numbers(pairs: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Positions of pair numbers in the sorted ``kept``, -1 for others."""
    if not len(kept):
        return np.full(len(pairs), -1, np.int64)
    at = np.minimum(np.searchsorted(kept, pairs), len(kept) - 1)
    return np.where(kept[at] == pairs, at, -1)


def _levels(codes: np.ndarray, rows: np.ndarray, sizes: list[int], kept: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of the kept 1-grams, 2-grams ... that begin at each token."""
    out = [codes]
    for n, own in enumerate(kept, 2):
        out.append(_numbers(_pairs(out[-1], rows, n, sizes[n - 2]), own))
    return out


def _distinct(rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, number) and how often each is there."""
    order = np.lexsort((numbers, rows))
    rows, numbers = rows[order], numbers[order]
    starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (numbers[1:] != numbers[:-1])]) if len(rows) else np.zeros(0, int)
    return rows[starts], numbers[starts], np.diff(np.r_[starts, len(rows)])


def dense_counts(toks: DataFrame, vocabulary: list[tuple[str, int]], least: float, n_min: int, n_max: int, min_chars: int,
                 most: int) -> DataFrame | None:
    """``(doc_id, term, tf, doc_total, df)`` of the n-grams of ``toks(doc_id, tokens)``
    that are in more than ``least`` rows.  ``vocabulary`` has the tokens that are,
    with their row counts.  More than ``most`` n-grams of a length: None."""
    id_type = toks.schema["doc_id"].dataType.simpleString()
    words = [w for w, _ in vocabulary]

    def coded(batches):
        known = pa.array(words, pa.string())
        for part, rows, tokens in _parts(batches, "tokens"):
            codes = pc.fill_null(pc.index_in(tokens, value_set=known), -1)
            chars, total = pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(part.num_rows, np.int64)
            upto = np.r_[0, np.cumsum(chars)]
            for n in range(n_min, n_max + 1):
                at = np.flatnonzero(_inside(rows, n))
                at = at[upto[at + n] - upto[at] + n - 1 >= min_chars]
                total += np.bincount(rows[at], minlength=part.num_rows)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=part.num_rows))], pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, codes.cast(pa.int32())),
                                              pa.array(total, pa.int32())], ["doc_id", "codes", "doc_total"])

    docs = written_table(toks.select("doc_id", "tokens").mapInArrow(coded, f"doc_id {id_type}, codes array<int>, doc_total int"), "codes")
    sizes, kept, dfs, names = [len(words)], [], [[d for _, d in vocabulary]], [words]
    for n in range(2, n_max + 1):
        def found(batches, n=n, sizes=tuple(sizes), kept=tuple(kept)):
            for _, rows, codes in _parts(batches, "codes"):
                ids = _levels(codes.to_numpy(zero_copy_only=False).astype(np.int64), rows, sizes, kept)[-1]
                pairs = _pairs(ids, rows, n, sizes[-1])
                _, own, _ = _distinct(rows[pairs >= 0], pairs[pairs >= 0])
                own, counts = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(counts, pa.int64())], ["pair", "n"])

        pairs = written_table(docs.select("codes").mapInArrow(found, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("df"))
                              .where(F.col("df") > least), "grams")
        if pairs.count() > most:
            return None
        rows = sorted((r.pair, r.df) for r in pairs.collect())
        kept.append(np.array([p for p, _ in rows], np.int64))
        dfs.append([d for _, d in rows])
        shorter = names[-1]
        # The second part's last token ends the n-gram.
        names.append([f"{shorter[p // sizes[-1]]} {shorter[p % sizes[-1]].rsplit(' ', 1)[-1]}" for p, _ in rows])
        sizes.append(len(rows))

    terms = [t for own in names[n_min - 1:] for t in own]
    frequencies = [d for own in dfs[n_min - 1:] for d in own]
    bases = np.cumsum([0, *sizes[n_min - 1:]])
    long_enough = np.array([len(t) >= min_chars for t in terms], bool)

    def counted(batches):
        all_terms, all_dfs = pa.array(terms, pa.string()), pa.array(frequencies, pa.int64())
        for part, rows, codes in _parts(batches, "codes"):
            levels = _levels(codes.to_numpy(zero_copy_only=False).astype(np.int64), rows, sizes, kept)[n_min - 1:]
            row = np.concatenate([rows[ids >= 0] for ids in levels])
            term = np.concatenate([ids[ids >= 0] + base for ids, base in zip(levels, bases)])
            row, term = row[long_enough[term]], term[long_enough[term]]
            row, term, tf = _distinct(row, term)
            row, term = pa.array(row, pa.int64()), pa.array(term, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), all_terms.take(term), pa.array(tf, pa.int64()),
                                              part.column("doc_total").take(row), all_dfs.take(term)],
                                             ["doc_id", "term", "tf", "doc_total", "df"])

    out = docs.mapInArrow(counted, f"doc_id {id_type}, term string, tf long, doc_total int, df long")
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out  # a row a document: nothing to add up
    return out.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.max("doc_total").alias("doc_total"), F.max("df").alias("df"))
