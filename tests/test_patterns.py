"""Flags by plain search give what their regexes give."""

import re

from pyspark.sql import functions as F

from newsfeat.functions import fixed
from newsfeat.functions import patterns as pt


def test_alternatives_as_plain_texts():
    assert pt.plain_texts("(obama|u\\.n\\.|chin(a|e)|poll(s|)|[0-9]{4}|a b|x*|q.z)") == (
        ["obama", "u.n.", "china", "chine", "polls", "poll", "a b"], ["[0-9]{4}", "x*", "q.z"])
    assert pt.plain_texts("(a\\|b|[|)]c|d)") == (["a|b", "d"], ["[|)]c"])
    for other in ("^(a|b)", "(a)(b)", "(?i)a", "(a|)", "([0-9]{4})", "((a|b)|c", "abc", "(a)|(b)", "((a|b)(c|d)(e|f)(g|h))", "(ab+)"):
        assert pt.plain_texts(other) == ([], [other])


def test_default_flags_equal_their_regexes(spark):
    rows = [None, "", "?", "Nothing to see", "in 2014 or 201", "The U.N. said", "uXnX", "CHINE", "Chin", "Islamic  state", "islamic state",
            "SocIal Media", "social", "\u0130ran", "\u212aerry", "wall st\n", "\u00e9conomie", "cash\u0000", "q. and a.", "q, and a."]
    specs = pt.default_flags() + [pt.FlagSpec("P", "Text", "contains", True, tuple(fixed.POLITICS_TEXT_TERMS)),
                                  pt.FlagSpec("A", "Text", "contains", False, tuple(fixed.POLITICS_TEXT_ACRONYMS))]
    for s in specs:
        for alternative in s.alternatives:
            plain = re.sub(r"\\(.)", r"\1", re.sub(r"\((\w*)\|.*?\)", r"\1", alternative)).replace("[0-9]{4}", "1999")
            rows += [plain, f"some {plain} here", f"so{plain.upper()}me", plain[:-1]]
    df = spark.createDataFrame([(x,) for x in dict.fromkeys(rows)], "t string").repartition(8)
    low = F.lower("t")
    wrong = [F.count_if(pt.matches("t", s.pattern(), s.ignore_case) != F.coalesce(
        low.rlike(pt.lower_pattern(s.pattern())) if s.ignore_case else F.col("t").rlike(s.pattern()), F.lit(False))) for s in specs]
    hits = [F.count_if(pt.matches("t", s.pattern(), s.ignore_case)) for s in specs]
    found = df.agg(*[x.alias(f"x{i}") for i, x in enumerate(wrong + hits)]).first()
    assert not any(found[:len(specs)]) and all(found[len(specs):])


def test_regexes_are_left_only_where_needed(spark):
    """Before, every flag was one regex of all alternatives."""
    df = spark.createDataFrame([("a",)], "Text string")
    specs = {s.name: s for s in pt.default_flags()}
    plan = {n: df.select(pt.flag(specs[n]))._jdf.queryExecution().optimizedPlan().toString() for n in ("War", "Boring", "Current")}
    assert "RLIKE" not in plan["War"].upper() and "RLIKE" not in plan["Current"].upper()
    assert "([0-9]{4})" in plan["Boring"] and "spotify|" not in plan["Boring"]
