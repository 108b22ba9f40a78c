"""The ``articles`` fixture: the article schema derived from ``documents`` and
``labels`` (one row per document, ``Popular`` null where unlabelled).

The derivation (headline from the first line with HTML wrapped around it,
the whole body after it as snippet or abstract, its first paragraph as the
other, categories and publication time as functions of the id) is described in FIXTURES.md; its SQL twin lives in
``newsfeat.plans.oracle.ARTICLES_SQL``.  Work grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.sources import tables

# Fixture category assignment: id modulo -> label ('' = missing category).
DESK_BY_MOD7 = {1: "Culture", 2: "Business", 3: "Styles", 4: "OpEd", 6: "Foreign"}
SECTION_BY_MOD11 = {1: "Arts", 2: "Business Day", 3: "Health", 4: "Crosswords/Games", 5: "U.S.",
                    6: "Opinion", 7: "Technology", 8: "Travel", 10: "World"}
SUBSECTION_MOD3_ZERO = "Dealbook"
PUBDATE_EPOCH_START = 1409529600  # 2014-09-01 00:00:00
PUBDATE_SPAN_SECONDS = 10540800   # 122 days
PUBDATE_MULTIPLIER = 7919 * 61

# What stands after the headline line (all of a text of one line).  Even ids: the
# abstract is the body, the snippet its first paragraph; odd ids the other way
# round; ids ending in 0 or 5 have the body in both, a tie.
BODY_PATTERN = "^[^\n]*\n"
SNIPPET_IS_PARAGRAPH = [2, 4, 6, 8]
ABSTRACT_IS_PARAGRAPH = [1, 3, 7, 9]

# Fixture dictionaries for queries on synthetic text (FIXTURES.md section 3):
# (name, field, mode, ignore_case, alternatives).
FIXTURE_FLAGS = [
    ("Bang", "Headline", "contains", False, ["!"]),
    ("Year", "Headline", "contains", False, ["[0-9]{4}"]),
    ("TheAnd", "Headline", "word", True, ["the", "and"]),
    ("Opener", "Headline", "prefix", True, ["the", "of", "and", "est"]),
    ("CapThe", "Text", "word", False, ["The"]),
    ("Secret", "Summary", "contains", True, ["license", "password", "email"]),
]
FIXTURE_POLITICS_PREFIXES = ["the", "of", "and", "est", "re", "in", "on"]
FIXTURE_PHRASES = [("of the", "OfThe"), ("the", "THE")]
# Total weight from which a term counts as frequent (the library's default, 20, is
# above every term of the synthetic text).
FIXTURE_TEXT_MIN_WEIGHT = 2.0
FIXTURE_STOPWORDS = ["the", "and", "of", "to", "in", "that", "with", "for", "by"]


def _mod_label(c: Column, mapping: dict[int, str], default: str = "") -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tables.documents(spark, sf_dir)
    lab = tables.labels(spark, sf_dir).withColumnRenamed("quality", "Popular")
    first_line = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    body = F.regexp_replace(F.col("text"), F.lit(BODY_PATTERN), F.lit(""))
    paragraph = F.split_part(body, F.lit("\n"), F.lit(1))
    turn = F.col("doc_id") % 10
    seconds = F.lit(PUBDATE_EPOCH_START) + (F.col("doc_id") * PUBDATE_MULTIPLIER) % PUBDATE_SPAN_SECONDS
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (d.join(lab, "doc_id", "left")
            .select(
                F.col("doc_id").alias("UniqueID"),
                _mod_label(F.col("doc_id") % 7, DESK_BY_MOD7).alias("NewsDesk"),
                _mod_label(F.col("doc_id") % 11, SECTION_BY_MOD11).alias("SectionName"),
                F.when(F.col("doc_id") % 3 == 0, F.lit(SUBSECTION_MOD3_ZERO)).otherwise(F.lit(""))
                 .alias("SubsectionName"),
                F.concat(F.lit("<b>"), F.replace(first_line, F.lit("é"), F.lit("&eacute;")),
                         F.lit("</b>&hellip; ")).alias("Headline"),
                F.when(turn.isin(SNIPPET_IS_PARAGRAPH), paragraph).otherwise(body).alias("Snippet"),
                F.when(turn.isin(ABSTRACT_IS_PARAGRAPH), paragraph).otherwise(body).alias("Abstract"),
                (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1)
                 .cast("int").alias("WordCount"),
                F.timestamp_add("SECOND", seconds, epoch).alias("PubDate"),
                F.col("Popular").cast("int").alias("Popular"),
            ))


def fixture_flag_specs():
    from newsfeat.functions.patterns import FlagSpec
    return [FlagSpec(n, f, m, ic, tuple(a)) for n, f, m, ic, a in FIXTURE_FLAGS]
