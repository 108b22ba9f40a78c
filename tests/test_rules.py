from pyspark.sql import functions as F

from newsfeat.operators import rules

SCHEMA = "UniqueID long, NewsDesk string, SectionName string, SubsectionName string, Headline string, Text string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = rules.fill_categories(df, **kw)
    return {r["UniqueID"]: (r["NewsDesk"], r["SectionName"], r["SubsectionName"]) for r in out.collect()}


def test_puzzles_masked_update(spark):
    got = run(spark, [(1, "", "Crosswords/Games", "Sub", "h", "t")])
    assert got[1] == ("Styles", "Puzzles", "Missing")


def test_fill_order_desk_from_section(spark):
    got = run(spark, [(1, "", "Technology", "", "h", "t")])
    assert got[1] == ("Business", "Technology", "Missing")


def test_styles_us_rule_then_section_fill(spark):
    got = run(spark, [(1, "Styles", "U.S.", "x", "h", "t"), (2, "Styles", "", "", "h", "t")])
    assert got[1] == ("Styles", "Style", "Missing")
    assert got[2] == ("Styles", "Style", "Missing")


def test_masked_update_uses_old_values(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, x string, y string")
    out = rules.masked_update(df, F.col("x") == "a", {"x": "changed", "y": "set"}).first()
    assert (out["x"], out["y"]) == ("changed", "set")


def test_politics_rules_in_order(spark):
    rows = [(1, "", "", "", "First Draft: today", "First Draft: today"),
            (2, "", "", "", "nothing", "the senator said"),
            (3, "Foreign", "", "", "x", "GOP"),
            (4, "", "", "", "x", "gop lowercase")]
    got = run(spark, rows)
    assert got[1] == ("National", "U.S.", "Politics")
    assert got[2] == ("National", "U.S.", "Politics")
    # Desk Foreign fills the section first (World), so the acronym rule cannot fire.
    assert got[3] == ("Foreign", "World", "Missing")
    assert got[4] == ("Missing", "Missing", "Missing")
