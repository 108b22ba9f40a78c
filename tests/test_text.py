import pytest
from pyspark.sql import functions as F

from newsfeat.functions import text as tx
from newsfeat.functions.patterns import FlagSpec, flag


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "s string")
    return df.select(expr(F.col("s")).alias("r")).first()["r"]


def test_entity_quirk_strict_and_lenient(spark):
    assert one(spark, "a&mdash;b", lambda c: tx.drop_entities(c, True)) == "a;b"
    assert one(spark, "a&mdash;b", lambda c: tx.drop_entities(c, False)) == "ab"


def test_single_quotes_removed_whole(spark):
    assert one(spark, "it&lsquo;s&rsquo;", tx.drop_entities) == "its"


def test_diacritics_folded_unknown_kept(spark):
    assert one(spark, "caf&eacute; na&iuml;ve", tx.fold_diacritic_entities) == "cafe naive"
    assert one(spark, "&szlig;", tx.fold_diacritic_entities) == "&szlig;"


def test_tag_across_lines(spark):
    assert one(spark, "<p\nx>hi</p>", tx.strip_tags) == "hi"


def test_trim_every_whitespace(spark):
    assert one(spark, "\t\n a b \x0b\f\r ", tx.trim_ws) == "a b"


def test_cleanup_order(spark):
    assert one(spark, " <b>caf&eacute;</b>&hellip; ", tx.cleanup_text) == "cafe;"


@pytest.mark.parametrize("text,expected", [("", 2), ("One", 2), ("One two", 2), ("One, two three!", 3)])
def test_word_count_plus_one(spark, text, expected):
    assert one(spark, text, tx.word_count) == expected


def test_summary_tie_takes_second(spark):
    df = spark.createDataFrame([("abc", "xyz"), ("abcd", "xyz")], "a string, b string")
    got = [r["r"] for r in df.select(tx.longer_of("a", "b").alias("r")).collect()]
    assert got == ["xyz", "abcd"]


def test_mgsub_length_mismatch():
    with pytest.raises(ValueError):
        tx.mgsub(F.col("s") if False else "s", ["a", "b"], ["x"])


def test_mgsub_order_dependent(spark):
    got = one(spark, "Out of the box", lambda c: tx.mgsub(c, ["of the", "the"], ["OfThe", "THE"]))
    assert got == "Out OfTHE box"


def test_null_text_flag_is_zero(spark):
    spec = FlagSpec("X", "s", "contains", True, ("abc",))
    df = spark.createDataFrame([(None,), ("xABCx",)], "s string")
    assert [r["f"] for r in df.select(flag(spec).alias("f")).collect()] == [0, 1]


def test_whole_word_mode_respects_accents(spark):
    spec = FlagSpec("X", "s", "word", True, ("the",))
    df = spark.createDataFrame([("the end",), ("théâtre",), ("bathe",), ("(The)",)], "s string")
    assert [r["f"] for r in df.select(flag(spec).alias("f")).collect()] == [1, 0, 0, 1]


def test_chart_data_sink_roundtrip(spark, tmp_path):
    from newsfeat.sources.csv import write_chart_data
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 1.0)], "g string, i int, scaled double")
    write_chart_data(df, str(tmp_path / "chart"))
    back = spark.read.parquet(str(tmp_path / "chart"))
    assert sorted(back.collect()) == sorted(df.collect())


def test_submission_sink_roundtrip(spark, tmp_path):
    from newsfeat.sources.csv import read_submission, write_submission
    df = spark.createDataFrame([(1, 0.25), (2, 0.75)], "UniqueID long, p double")
    write_submission(df, str(tmp_path / "sub"), "p")
    got = {r["UniqueID"]: r["Probability1"] for r in read_submission(spark, str(tmp_path / "sub")).collect()}
    assert got == {1: 0.25, 2: 0.75}


def test_lower_pattern_keeps_escapes_and_classes():
    from newsfeat.functions.patterns import build_pattern, lower_pattern
    assert lower_pattern(r"^(First Draft|U\.N\.)\?") == r"^(first draft|u\.n\.)\?"
    word = build_pattern(["The"], "word")
    assert lower_pattern(word) == r"(^|[^\p{L}\p{N}_])(the)($|[^\p{L}\p{N}_])"
    assert lower_pattern(r"\W+\S") == r"\W+\S"


def test_phrases_in_any_case_and_none(spark):
    from newsfeat.functions import fixed
    texts = ["in NEW york City", "\u017filicon Valley", "S\u0130licon valley", "new yor\u212a", "wh\u0131te house", "nothing here", "", None, "Big  data"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.col("t")
    for p, r in fixed.PHRASES:
        plain = F.regexp_replace(plain, "(?iu)" + p, r)
    got = df.select("i", tx.phrase_collapse("t").alias("a"), plain.alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [r.b for r in got] and got[0].a == "in NYC" and got[1].a == "SiliconValley"
    plan = df.select(tx.phrase_collapse("t").alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert "exists" in plan
