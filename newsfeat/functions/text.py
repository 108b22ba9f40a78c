"""Text-cleaning column expressions (all JVM-side, whole-stage codegen).

Every function takes and returns a ``Column``.  The regex dialect is the
common subset of Java and RE2, so the same pattern string can be checked
against DuckDB (``newsfeat.plans.oracle``) without translation; only the
replacement back-reference syntax differs (``$1`` here, ``\\1`` in RE2).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfeat.functions.fixed import (DIACRITIC_ENTITY_SUFFIXES,
                                      DROPPED_ENTITIES_WITH_SEMICOLON,
                                      DROPPED_ENTITIES_WITHOUT_SEMICOLON, PHRASES)

# Whitespace as the script's trim sees it (space, tab, newline, vertical tab,
# form feed, carriage return); spelled out because Java's and RE2's ``\s``
# disagree on the vertical tab.
WHITESPACE = r"[\t\n\x0B\f\r ]"
TRIM_PATTERN = rf"^{WHITESPACE}+|{WHITESPACE}+$"

DIACRITIC_PATTERN = r"&(\p{L})(" + "|".join(DIACRITIC_ENTITY_SUFFIXES) + ");"


def drop_entities_pattern(strict: bool = True) -> str:
    """Pattern of removed entities.

    ``strict=True`` reproduces the analysed script exactly: only the quote
    entities lose their ``;``, so ``a&mdash;b`` becomes ``a;b``.
    ``strict=False`` removes the ``;`` of every listed entity.
    """
    if strict:
        names = DROPPED_ENTITIES_WITHOUT_SEMICOLON + [f"{e};" for e in DROPPED_ENTITIES_WITH_SEMICOLON]
        return "&(" + "|".join(names) + ")"
    names = DROPPED_ENTITIES_WITHOUT_SEMICOLON + DROPPED_ENTITIES_WITH_SEMICOLON
    return "&(" + "|".join(names) + ");"


# Shortest ``<...>`` span, newlines included.
TAG_PATTERN = "<.*?>"
# Punctuation and symbols removed before counting words, and the separator
# runs that are counted.
PUNCT_PATTERN = r"[\p{P}\p{S}]"
WORD_SEPARATOR_PATTERN = r"[^\p{L}\p{N}_]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Remove leading and trailing whitespace of every kind (not only spaces)."""
    return F.regexp_replace(_col(c), TRIM_PATTERN, "")


def fold_diacritic_entities(c) -> Column:
    """``&eacute;`` -> ``e``: letter entities with acute/cedil/circ/grave/uml."""
    return F.regexp_replace(_col(c), DIACRITIC_PATTERN, "$1")


def drop_entities(c, strict: bool = True) -> Column:
    """Remove dash, ellipsis and single-quote entities (see ``drop_entities_pattern``)."""
    return F.regexp_replace(_col(c), drop_entities_pattern(strict), "")


def strip_tags(c) -> Column:
    """Remove the shortest ``<...>`` spans, also across newlines."""
    return F.regexp_replace(_col(c), "(?s)" + TAG_PATTERN, "")


def cleanup_text(c, strict: bool = True) -> Column:
    """Tags, then entities, then diacritic entities, then trim - in that order."""
    return trim_ws(fold_diacritic_entities(drop_entities(strip_tags(c), strict)))


# What Java's ``(?iu)`` takes for an ASCII letter although its lower case is none:
# long s, dotless and dotted i, and the Kelvin sign.
LETTER_LIKE = ["\u017f", "\u0131", "\u0130", "\u212a"]


def mgsub(c, patterns: list[str], replacements: list[str], ignore_case: bool = True) -> Column:
    """Apply ``(pattern, replacement)`` pairs in order; later pairs see earlier output.

    Without regard to case, a text without any of the patterns stays as it is after
    one plain search for each of them; case-blind regexes run on the others only
    (where all patterns are ASCII letters, digits and spaces)."""
    if len(patterns) != len(replacements):
        raise ValueError(f"{len(patterns)} patterns for {len(replacements)} replacements")
    prefix = "(?iu)" if ignore_case else ""
    col = _col(c)
    out = reduce(lambda acc, pr: F.regexp_replace(acc, prefix + pr[0], pr[1]), zip(patterns, replacements), col)
    if not ignore_case or not patterns or not all(re.fullmatch("[A-Za-z0-9 ]+", p) for p in patterns):
        return out
    # An array of one text, so that it is lowered once for all searches.
    found = F.exists(F.array(F.lower(col)), lambda t: reduce(Column.__or__, [t.contains(p.lower()) for p in patterns]))
    found = reduce(Column.__or__, [col.contains(x) for x in LETTER_LIKE], found)
    return F.when(found, out).otherwise(col)


def phrase_collapse(c, phrases: list[tuple[str, str]] = PHRASES, ignore_case: bool = True) -> Column:
    """Join multi-word phrases into single tokens (``new york`` -> ``NewYork``)."""
    return mgsub(c, [p for p, _ in phrases], [r for _, r in phrases], ignore_case)


def longer_of(a, b) -> Column:
    """``a`` if strictly longer (in characters) than ``b``, else ``b`` (tie -> ``b``)."""
    a, b = _col(a), _col(b)
    return F.when(F.length(a) > F.length(b), a).otherwise(b)


def text_concat(a, b) -> Column:
    """``paste(a, b)``: join with one space."""
    return F.concat_ws(" ", _col(a), _col(b))


def char_count(c) -> Column:
    """Characters (code points), not bytes."""
    return F.length(_col(c))


def word_count(c) -> Column:
    """Punctuation removed, separator runs counted, plus one.

    No separator counts as one, so empty and one-word text give 2 - the
    analysed script's behaviour, kept on purpose.
    """
    cleaned = F.regexp_replace(_col(c), PUNCT_PATTERN, "")
    return (F.greatest(F.regexp_count(cleaned, F.lit(WORD_SEPARATOR_PATTERN)), F.lit(1)) + 1).cast("int")


def log1p_count(c) -> Column:
    """``log(1 + x)``, natural log."""
    return F.log1p(_col(c).cast("double"))
