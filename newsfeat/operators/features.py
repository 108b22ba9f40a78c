"""Article text cleaning and per-row features.

All of these are narrow projections: no shuffle, one whole-stage-codegen span
per stage, filters and column pruning pass straight through to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsfeat.functions import calendar as cal
from newsfeat.functions import fixed
from newsfeat.functions import text as tx
from newsfeat.functions.patterns import FlagSpec, default_flags, flag


def clean_articles(df: DataFrame, phrases=fixed.PHRASES, strict_entities: bool = True) -> DataFrame:
    """Headline cleaned; Summary = the longer of cleaned Snippet / Abstract (tie -> Abstract);
    phrases collapsed in both; ``Text = Headline + ' ' + Summary``."""
    snippet = tx.cleanup_text("Snippet", strict_entities)
    abstract = tx.cleanup_text("Abstract", strict_entities)
    df = df.withColumns({"Headline": tx.cleanup_text("Headline", strict_entities),
                         "__snippet": snippet, "__abstract": abstract})
    df = df.withColumn("Summary", tx.longer_of("__snippet", "__abstract")).drop("__snippet", "__abstract")
    if phrases:
        df = df.withColumns({"Headline": tx.phrase_collapse("Headline", phrases),
                             "Summary": tx.phrase_collapse("Summary", phrases)})
    return df.withColumn("Text", tx.text_concat("Headline", "Summary"))


def add_calendar(df: DataFrame, ts: str = "PubDate") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "PubDay": cal.pub_day(t),
        "Weekday": cal.weekday_sun0(t),
        "Hour": cal.hour_of(t),
    })


def add_lengths(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "LogWC": tx.log1p_count("WordCount"),
        "HeadlineCharCount": tx.char_count("Headline"),
        "SummaryCharCount": tx.char_count("Summary"),
        "HeadlineWordCount": tx.word_count("Headline"),
        "SummaryWordCount": tx.word_count("Summary"),
    })


def label_display(c: str = "Popular"):
    """0 / 1 as text, and ``N/A`` for unlabelled rows."""
    return F.coalesce(F.col(c).cast("string"), F.lit(fixed.UNLABELLED_DISPLAY))


def add_flags(df: DataFrame, flags: list[FlagSpec] | None = None, seo_max_chars: int = fixed.SEO_MAX_CHARS,
              holidays=fixed.HOLIDAYS) -> DataFrame:
    """SEO, keyword flags, Holiday and BeforeHoliday as 0/1 integers."""
    flags = default_flags() if flags is None else flags
    cols = {"SEO": F.coalesce(F.length("Headline") <= seo_max_chars, F.lit(False)).cast("int")}
    cols.update({f.name: flag(f) for f in flags})
    cols["Holiday"] = cal.holiday_flag(F.col("PubDate"), holidays)
    cols["BeforeHoliday"] = cal.before_holiday_flag(F.col("PubDate"), holidays)
    return df.withColumns(cols)


def add_day_of_week(df: DataFrame) -> DataFrame:
    """Weekday name plus its factor position (Monday = 0) for ordering."""
    return df.withColumns({"DayOfWeek": cal.weekday_name(F.col("PubDate")),
                           "DayOfWeekOrder": cal.weekday_mon0(F.col("PubDate"))})


def add_features(df: DataFrame, flags: list[FlagSpec] | None = None) -> DataFrame:
    df = add_calendar(df)
    df = add_lengths(df)
    df = df.withColumn("Pop", label_display())
    df = add_flags(df, flags)
    return add_day_of_week(df)


def flag_columns(flags: list[FlagSpec] | None = None) -> list[str]:
    flags = default_flags() if flags is None else flags
    return ["SEO"] + [f.name for f in flags] + ["Holiday", "BeforeHoliday"]


def model_frame(df: DataFrame, drop=fixed.MODEL_DROP_COLUMNS) -> DataFrame:
    """The modelling table: text and raw date columns dropped."""
    return df.drop(*drop)


def term_popularity(df: DataFrame, patterns: dict[str, tuple[str, bool]], label: str = "Popular",
                    fields: tuple[str, str] = ("Headline", "Text")) -> DataFrame:
    """Frequency and popularity of each pattern, labelled and unlabelled rows.

    ``patterns``: name -> (regex, ignore_case).  One projection computes a hit
    flag per pattern and field, an unpivot turns it into ``(pattern, ...)`` rows
    and one grouped aggregate (partial, then a tiny shuffle) gives, per
    pattern: mean label and count of labelled rows hitting the headline, the
    same for the text, and the unlabelled hit counts.  The mean of no rows is
    null (NaN in the script)."""
    from newsfeat.functions.patterns import matches
    head, text = fields
    names = list(patterns)
    structs = [F.struct(matches(head, p, ic).alias("h"), matches(text, p, ic).alias("t")).alias(n)
               for n, (p, ic) in patterns.items()]
    wide = df.select(F.col(label).cast("double").alias("__y"), *structs)
    long = wide.unpivot("__y", names, "pattern", "hit").select("pattern", "__y", "hit.h", "hit.t")
    lab = F.col("__y").isNotNull()
    return long.groupBy("pattern").agg(
        F.avg(F.when(lab & F.col("h"), F.col("__y"))).alias("avgPopHeadTrain"),
        F.count_if(lab & F.col("h")).alias("numArtHeadTrain"),
        F.avg(F.when(lab & F.col("t"), F.col("__y"))).alias("avgPopTextTrain"),
        F.count_if(lab & F.col("t")).alias("numArtTextTrain"),
        F.count_if(~lab & F.col("h")).alias("numArtHeadTest"),
        F.count_if(~lab & F.col("t")).alias("numArtTextTest"),
    )
