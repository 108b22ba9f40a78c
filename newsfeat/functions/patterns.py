"""Keyword-flag patterns.

A flag is described by data - ``FlagSpec(name, field, mode, ignore_case,
alternatives)`` - and compiled here into one regex predicate.  Users bring
their own tables; ``newsfeat.functions.fixed.FLAGS`` holds the analysed
script's own dictionaries.

Modes
-----
``contains``  any alternative anywhere.
``prefix``    an alternative at the start of the field.
``word``      an alternative as a whole word.  Word characters are Unicode
              letters, digits and ``_``; the boundary is written as a consumed
              character class so that Java and RE2 agree (their ``\\b`` differ
              on accented letters).

Null text never matches (the flag is 0).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfeat.functions.fixed import FLAGS

NON_WORD = r"[^\p{L}\p{N}_]"


@dataclass(frozen=True)
class FlagSpec:
    name: str
    field: str
    mode: str
    ignore_case: bool
    alternatives: tuple[str, ...]

    def pattern(self) -> str:
        return build_pattern(self.alternatives, self.mode)


def build_pattern(alternatives, mode: str = "contains") -> str:
    body = "(" + "|".join(alternatives) + ")"
    if mode == "contains":
        return body
    if mode == "prefix":
        return "^" + body
    if mode == "word":
        return f"(^|{NON_WORD}){body}($|{NON_WORD})"
    raise ValueError(f"unknown flag mode {mode!r}")


def lower_pattern(pattern: str) -> str:
    """Lower-case the literal letters of a regex, leaving escapes (``\\.``,
    ``\\?``) and property classes (``\\p{L}``) untouched."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            if nxt in "pP" and i + 2 < len(pattern) and pattern[i + 2] == "{":
                end = pattern.index("}", i + 2)
                out.append(pattern[i:end + 1])
                i = end + 1
                continue
            out.append(pattern[i:i + 2])
            i += 2
            continue
        out.append(ch.lower())
        i += 1
    return "".join(out)


def _branches(body: str) -> list[str]:
    """The alternatives of ``a|b|c``; bars inside groups, classes and escapes don't count."""
    out, start, depth, in_class, i = [], 0, 0, False, 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            if depth < 0:
                return []
        elif ch == "|" and not depth:
            out.append(body[start:i])
            start = i + 1
        i += 1
    return [*out, body[start:]]


MAX_TEXTS = 8  # plain texts that one alternative is written out as, at most


def _texts(alternative: str) -> list[str] | None:
    """The plain texts that a regex of letters, escaped punctuation and groups of such
    alternatives (``rac(e|y)``) stands for; None for any other regex."""
    found = [""]
    for group, escaped, plain, other in re.findall(r"\(([^()\[\]{}\\.^$*+?]*)\)(?![*+?{])|\\([^\w\s])(?![*+?{])|"
                                                   r"([^()\[\]{}\\.^$*+?|])(?![*+?{])|([\s\S])", alternative):
        if other:
            return None
        found = [x + y for x in found for y in ([escaped or plain] if escaped or plain else group.split("|"))]
        if len(found) > MAX_TEXTS:
            return None
    return found


def plain_texts(pattern: str) -> tuple[list[str], list[str]]:
    """``(texts, rest)``: the plain texts among the alternatives of ``(a|b|c)`` and the
    other alternatives; ``([], [pattern])`` for a pattern of another form."""
    branches = _branches(pattern[1:-1]) if pattern[:1] == "(" and pattern[-1:] == ")" and pattern[1:2] != "?" else []
    texts, rest = [], []
    for branch in branches:
        found = _texts(branch)
        texts += found or []
        rest += [branch] if found is None else []
    return (texts, rest) if texts and "" not in texts else ([], [pattern])


def matches(c, pattern: str, ignore_case: bool = False) -> Column:
    """Regex ``find`` predicate; null input gives ``False``.

    Ignoring case lower-cases the text once (shared by every flag on the same
    field through subexpression elimination) and matches the lower-cased
    pattern case-sensitively - per-character lowering, like the script's
    ``ignore.case``, and much cheaper than Java's Unicode case folding.

    Alternatives that are plain texts are looked for as such: a regex tries each of
    them anew at every character."""
    col = F.col(c) if isinstance(c, str) else c
    texts, rest = plain_texts(lower_pattern(pattern) if ignore_case else pattern)
    if texts:
        # An array of one text, so that it is lowered once for all searches.
        def found(t: Column) -> Column:
            return reduce(Column.__or__, [t.contains(x) for x in dict.fromkeys(texts)] + ([t.rlike("(" + "|".join(rest) + ")")] if rest else []))
        return F.coalesce(F.exists(F.array(F.lower(col) if ignore_case else col), found), F.lit(False))
    if ignore_case:
        return F.coalesce(F.lower(col).rlike(lower_pattern(pattern)), F.lit(False))
    return F.coalesce(col.rlike(pattern), F.lit(False))


def flag(spec: FlagSpec, fields: dict | None = None) -> Column:
    """0/1 integer column for one flag."""
    col = (fields or {}).get(spec.field, F.col(spec.field))
    return matches(col, spec.pattern(), spec.ignore_case).cast("int")


def default_flags() -> list[FlagSpec]:
    return [FlagSpec(n, f, m, ic, tuple(a)) for n, f, m, ic, a in FLAGS]
