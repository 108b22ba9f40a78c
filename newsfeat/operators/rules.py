"""Ordered category rules (fill blank desk / section / subsection).

The script writes each rule as a whole-column ``ifelse`` or a masked update.
Here:

* a chain of fills conditioned on the same blank column and on distinct
  values of another column is one first-match ``CASE`` (once a value is
  filled no later rule of the chain can fire), evaluated inside the
  projection - no join, no shuffle;
* a masked update evaluates its condition **once, on the old values**, then
  assigns all target columns (sequential ``withColumn`` would be wrong: the
  second assignment would see the first one's output);
* the order of the steps is kept, see ``fill_categories``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfeat.functions import fixed
from newsfeat.functions.patterns import build_pattern, matches

CATEGORY_COLUMNS = ("NewsDesk", "SectionName", "SubsectionName")


def _lookup_fill(df: DataFrame, target: str, key: str, table: list[tuple[str, str]]) -> DataFrame:
    blank = F.col(target) == ""
    expr = None
    for k, v in table:
        cond = blank & (F.col(key) == k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return df.withColumn(target, expr.otherwise(F.col(target)) if expr is not None else F.col(target))


def fill_desk_from_section(df: DataFrame, table=fixed.DESK_FROM_SECTION) -> DataFrame:
    return _lookup_fill(df, "NewsDesk", "SectionName", table)


def fill_section_from_desk(df: DataFrame, table=fixed.SECTION_FROM_DESK) -> DataFrame:
    return _lookup_fill(df, "SectionName", "NewsDesk", table)


def masked_update(df: DataFrame, condition: Column, assignments: dict[str, object],
                  flag_col: str = "__rule_hit") -> DataFrame:
    """Assign every column of ``assignments`` where ``condition`` held on the old row."""
    hit = F.col(flag_col)
    return (df.withColumn(flag_col, F.coalesce(condition, F.lit(False)))
              .withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in assignments.items()})
              .drop(flag_col))


def _category_assignments(values) -> dict[str, str]:
    return dict(zip(CATEGORY_COLUMNS, values))


def apply_category_rule(df: DataFrame, rule) -> DataFrame:
    """Rule ``(desk or None, section, (desk', section', subsection'))``."""
    desk, section, values = rule
    cond = F.col("SectionName") == section
    if desk is not None:
        cond = (F.col("NewsDesk") == desk) & cond
    return masked_update(df, cond, _category_assignments(values))


def regex_rule_fill(df: DataFrame, condition: Column, values=fixed.POLITICS_CATEGORIES) -> DataFrame:
    return masked_update(df, condition, _category_assignments(values))


def politics_rules(df: DataFrame,
                   headline_prefixes=fixed.POLITICS_HEADLINE_PREFIXES,
                   text_terms=fixed.POLITICS_TEXT_TERMS,
                   text_acronyms=fixed.POLITICS_TEXT_ACRONYMS) -> DataFrame:
    """Three rules in order; each sees the previous one's output."""
    all_blank = (F.col("NewsDesk") == "") & (F.col("SectionName") == "") & (F.col("SubsectionName") == "")
    section_blank = F.col("SectionName") == ""
    if headline_prefixes:
        df = regex_rule_fill(df, all_blank & matches("Headline", build_pattern(headline_prefixes, "prefix"), True))
    if text_terms:
        df = regex_rule_fill(df, section_blank & matches("Text", build_pattern(text_terms), True))
    if text_acronyms:
        df = regex_rule_fill(df, section_blank & matches("Text", build_pattern(text_acronyms), False))
    return df


def fill_missing(df: DataFrame, columns=CATEGORY_COLUMNS, label: str = fixed.MISSING_LABEL) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == "", F.lit(label)).otherwise(F.col(c)) for c in columns})


def fill_categories(df: DataFrame,
                    desk_from_section=fixed.DESK_FROM_SECTION,
                    section_from_desk=fixed.SECTION_FROM_DESK,
                    headline_prefixes=fixed.POLITICS_HEADLINE_PREFIXES,
                    text_terms=fixed.POLITICS_TEXT_TERMS,
                    text_acronyms=fixed.POLITICS_TEXT_ACRONYMS) -> DataFrame:
    """All category steps in the script's order (the order matters)."""
    df = fill_desk_from_section(df, desk_from_section)
    df = apply_category_rule(df, fixed.PUZZLES_RULE)
    df = apply_category_rule(df, fixed.STYLE_RULE)
    df = fill_section_from_desk(df, section_from_desk)
    df = politics_rules(df, headline_prefixes, text_terms, text_acronyms)
    return fill_missing(df)
