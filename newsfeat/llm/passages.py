"""Substring dedup by hashing sentences, lines or paragraphs.

Texts are cut into units (sentences inside lines; or whole lines, or paragraphs);
each unit is normalised (lower case, single spaces) and digested; digests are
grouped over the whole corpus; of each group the earliest occurrence stays, by
document id and then place.  Later occurrences go where neighbouring ones make
up a passage of some length; their offsets in the original text are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import read, utf8
from newsfeat.session import written_table

RUN_WORDS = 20        # words of neighbouring repeated units that make a passage
_WS = r"[ \t\n\r\f\x0b]"
SENTENCE, LINE, PARAGRAPH = "sentence", "line", "paragraph"
# A unit with what follows it: the white space after a sentence end or a break.
_PATTERN = {SENTENCE: rf"[^\n]*?(?:[.!?]{_WS}+|\n{_WS}*)|[^\n]+$",
            LINE: r"[^\n]*\n|[^\n]+$",
            PARAGRAPH: rf"(?s).+?(?:\n[ \t\r\f\x0b]*(?:\n[ \t\r\f\x0b]*)+|$)"}
_UNIT = {k: re.compile(v.replace("$", r"\Z")) for k, v in _PATTERN.items()}
_SPACE = re.compile(_WS + "+")
_ENTRY = "array<struct<hi:long,lo:long,first:int,last:int,words:int>>"
SPANS = "array<struct<first:int,last:int>>"


def units_of(text: str, unit: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, normalised unit); offsets are code points, the end includes
    the white space after the unit."""
    for m in _UNIT[unit].finditer(text):
        yield m.start(), m.end(), _SPACE.sub(" ", m.group().lower()).strip(" ")


def unit_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = SENTENCE) -> DataFrame:
    """``(doc_id, text_hash, units)``, one row per input row: the digests, places
    and word counts of its units (0 words: digest 0)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, digests, rest = [0], [], []
            for raw in batch.column(2):
                for start, end, norm in units_of(raw.as_py().decode("utf-8", "replace"), unit):
                    digests.append(xxhash.xxh3_128_digest(norm.encode("utf-8")) if norm else bytes(16))
                    rest += (start, end, norm.count(" ") + 1 if norm else 0)
                offsets.append(len(digests))
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            places = np.array(rest, np.int32).reshape(-1, 3)
            columns = [halves[:, 0], halves[:, 1], places[:, 0], places[:, 1], places[:, 2]]
            entries = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["hi", "lo", "first", "last", "words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)],
                names=["doc_id", "text_hash", "units"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("h"), utf8(text_col).alias("t"))
    return narrow.mapInArrow(run, f"doc_id long, text_hash long, units {_ENTRY}")


def passages(later: list[dict], run_words: int) -> list[dict]:
    """The spans of neighbouring later occurrences (place ``i``, first, last,
    words), in order, that hold enough words."""
    spans, words = [], 0
    for n, u in enumerate(later):
        if n and u["i"] == later[n - 1]["i"] + 1:
            spans[-1]["last"], words = u["last"], words + u["words"]
        else:
            if spans and words < run_words:
                spans.pop()
            spans.append({"first": u["first"], "last": u["last"]})
            words = u["words"]
    return spans[:-1] if spans and words < run_words else spans


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = SENTENCE,
                   run_words: int = RUN_WORDS) -> DataFrame:
    """``(doc_id, text_hash, spans)`` of the documents that lose passages.

    The first half of the digests of all units are counted with partial
    aggregation; only units that repeat by it are brought together.  The group
    tables are written and the joins back stand alone, on narrow rows, so that
    adaptive execution splits a digest with a large share of them.
    """
    rows = written_table(unit_rows(docs, id_col, text_col, unit), "units")
    units = rows.select("doc_id", "text_hash", F.posexplode("units").alias("i", "u")).where("u.words > 0")
    often = written_table(units.groupBy(F.col("u.hi").alias("hi")).agg(F.count("*").alias("n")).where("n > 1").drop("n"),
                          "unit-repeats")
    repeats = written_table(
        units.select("doc_id", "text_hash", "i", "u.*").join(often, "hi")
        .select("doc_id", "text_hash", "i", "hi", "lo", "first", "last", "words"), "unit-occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "i")
    groups = written_table(repeats.groupBy("hi", "lo").agg(F.min(place).alias("kept"), F.max(place).alias("most"))
                           .where("kept != most").drop("most"), "unit-groups")
    later = (repeats.join(groups, ["hi", "lo"]).where(place != F.col("kept"))
             .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("i", "first", "last", "words"))).alias("later")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            spans = [passages(x.as_py(), run_words) for x in batch.column(2)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)],
                                             names=["doc_id", "text_hash", "spans"])
            yield out.filter(pa.array([bool(s) for s in spans], pa.bool_()))

    return later.mapInArrow(join, f"doc_id long, text_hash long, spans {SPANS}")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = SENTENCE,
                    run_words: int = RUN_WORDS, removed_col: str = "removed") -> DataFrame:
    """``docs`` without later occurrences of repeated passages; every row stays,
    and ``removed_col`` holds the cut (first, last) offsets in the original text.

    A passage is a run of neighbouring units, each repeated and none the earliest
    of its kind, of ``run_words`` words or more; shorter runs stay.  Rows without
    an id rank last, then by a hash of their text; rows with the same id and text
    count as one document; null texts stay null; an empty table gives no rows.
    """
    spans = repeated_spans(docs, id_col, text_col, unit, run_words).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans"))

    @F.pandas_udf("string")
    def cut(raw: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(raw, firsts, lasts):
            text, at, parts = t.decode("utf-8", "replace"), 0, []
            for first, last in zip(a, b):
                parts.append(text[at:first])
                at = last
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
                       & (F.xxhash64(text_col) == F.col("__hash")), "left")
    spans_of = F.coalesce("__spans", F.array().cast(SPANS))
    changed = F.col("__spans").isNotNull()
    # Texts without a cut don't travel to Python.
    text = cut(F.when(changed, utf8(text_col)).otherwise(F.lit(b"")), spans_of["first"], spans_of["last"])
    columns = [F.when(changed, text).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns
               if c != removed_col]
    return joined.select(*columns, spans_of.alias(removed_col))


def q_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.to_json("removed").alias("removed"), F.size("removed").alias("n_removed"))


# DuckDB's form.
SQL = f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '{_PATTERN[SENTENCE]}') AS pieces FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece FROM p),
o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS last,
             trim(regexp_replace(lower(piece), '{_WS}+', ' ', 'g'), ' ') AS unit FROM l),
x AS (SELECT *, last - length(piece) AS first, CASE WHEN unit = '' THEN 0 ELSE len(string_split(unit, ' ')) END AS words,
             unit <> '' AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, i) > 1 AS later FROM o),
g AS (SELECT *, sum((NOT later)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM x),
r AS (SELECT doc_id, run, min(first) AS first, max(last) AS last FROM g WHERE later GROUP BY doc_id, run
      HAVING sum(words) >= {RUN_WORDS}),
cuts AS (SELECT doc_id, '[' || string_agg('{{"first":' || first || ',"last":' || last || '}}', ',' ORDER BY first) || ']' AS removed,
                count(*)::INT AS n_removed FROM r GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(piece, '' ORDER BY i) FILTER (NOT later OR r.doc_id IS NULL) AS text
         FROM g LEFT JOIN r ON g.doc_id = r.doc_id AND g.run = r.run GROUP BY g.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(removed, '[]') AS removed, coalesce(n_removed, 0)::INT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN cuts USING (doc_id)"""
