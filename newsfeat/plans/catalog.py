"""Registered queries: one per operator family of the survey, each paired with
its DuckDB oracle SQL (or none, for model / iterative output that SQL cannot
express - those are covered by property tests).

Every query reads the given tables (or data Spark derives from them) in full.
Output columns are aliased identically on both sides; days are ISO strings and
doubles that depend on summation order are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.functions import fixed
from newsfeat.functions import text as tx
from newsfeat.operators import blend as bl
from newsfeat.operators import charts
from newsfeat.operators import evaluate as ev
from newsfeat.operators import hierarchy
from newsfeat.operators import lda
from newsfeat.operators import models as md
from newsfeat.operators import textmining as tmx
from newsfeat.operators import topics as tp
from newsfeat.operators import features as ft
from newsfeat.operators import rules
from newsfeat.operators import sets
from newsfeat.operators import temporal as tm
from newsfeat.plans import oracle as o
from newsfeat.plans import pipeline
from newsfeat.session import shared_path, written_table
from newsfeat.sources import csv as csvio
from newsfeat.sources import fixtures as fx
from newsfeat.sources import tables


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def day_str(c: str = "PubDay"):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


def s_day_str(c: str = "PubDay") -> str:
    return f"strftime({c}, '%Y-%m-%d') AS {c}"


def r6(c: str, alias: str | None = None):
    return F.round(F.col(c), 6).alias(alias or c)


def s_r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


ARTICLE_COLS = ["UniqueID", "NewsDesk", "SectionName", "SubsectionName", "Headline", "Snippet",
                "Abstract", "WordCount", "PubDate", "Popular"]


def pubdate_str():
    return F.date_format("PubDate", "yyyy-MM-dd HH:mm:ss").alias("PubDate")


S_PUBDATE_STR = "strftime(PubDate, '%Y-%m-%d %H:%M:%S') AS PubDate"
S_ARTICLE_SELECT = ", ".join(c if c != "PubDate" else S_PUBDATE_STR for c in ARTICLE_COLS)


def _article_select(df: DataFrame) -> DataFrame:
    return df.select(*[c if c != "PubDate" else pubdate_str() for c in ARTICLE_COLS])


def articles(spark, sf_dir):
    return fx.articles(spark, sf_dir)


def cleaned(spark, sf_dir):
    return ft.clean_articles(articles(spark, sf_dir))


def filled(spark, sf_dir, fixture_rules: bool = True):
    kw = {"headline_prefixes": fx.FIXTURE_POLITICS_PREFIXES} if fixture_rules else {}
    return rules.fill_categories(cleaned(spark, sf_dir), **kw)


def features(spark, sf_dir, counts: bool = True):
    return pipeline.article_features(articles(spark, sf_dir),
                                     rule_kwargs={"headline_prefixes": fx.FIXTURE_POLITICS_PREFIXES},
                                     counts=counts)


RULE_KW = {"headline_prefixes": fx.FIXTURE_POLITICS_PREFIXES}
FEATURE_SQL_PREFIX = o.feature_chain(**RULE_KW)


# ------------------------------------------------------------ 2.1 sources
@register("csv_scan", f"SELECT {S_ARTICLE_SELECT} FROM ({o.ARTICLES_SQL}) a")
def q_csv_scan(spark, sf_dir):
    path = shared_path(spark, "articles-csv")
    csvio.write_articles_csv(articles(spark, sf_dir), path)
    return _article_select(csvio.read_articles_csv(spark, path))


@register("union_train_test", f"SELECT {S_ARTICLE_SELECT} FROM ({o.ARTICLES_SQL}) a")
def q_union(spark, sf_dir):
    a = articles(spark, sf_dir)
    train, test = sets.split_labelled(a)
    return _article_select(sets.union_train_test(train, test.drop("Popular")))


@register("split_labelled", o.with_articles(
    "x AS (SELECT UniqueID, CASE WHEN Popular IS NULL THEN 'unlabelled' ELSE 'labelled' END AS part FROM articles)")
    + " SELECT * FROM x")
def q_split(spark, sf_dir):
    train, test = sets.split_labelled(articles(spark, sf_dir))
    return (train.select("UniqueID", F.lit("labelled").alias("part"))
            .unionByName(test.select("UniqueID", F.lit("unlabelled").alias("part"))))


# ------------------------------------------------------------ 2.8 scalar text
@register("trim_ws", f"SELECT doc_id, {o.s_trim_ws('text')} AS text FROM documents")
def q_trim(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", tx.trim_ws("text").alias("text"))


@register("strip_tags", f"SELECT page_id, {o.s_strip_tags('html')} AS text FROM pages")
def q_strip_tags(spark, sf_dir):
    return tables.pages(spark, sf_dir).select("page_id", tx.strip_tags("html").alias("text"))


@register("fold_diacritic_entities", o.with_articles(
    f"x AS (SELECT UniqueID, {o.s_fold_diacritics('Headline')} AS Headline FROM articles)") + " SELECT * FROM x")
def q_fold(spark, sf_dir):
    return articles(spark, sf_dir).select("UniqueID", tx.fold_diacritic_entities("Headline").alias("Headline"))


@register("drop_entities", o.with_articles(
    f"x AS (SELECT UniqueID, {o.s_drop_entities('Headline', True)} AS strict, "
    f"{o.s_drop_entities('Headline', False)} AS lenient FROM articles)") + " SELECT * FROM x")
def q_drop_entities(spark, sf_dir):
    return articles(spark, sf_dir).select("UniqueID", tx.drop_entities("Headline", True).alias("strict"),
                                          tx.drop_entities("Headline", False).alias("lenient"))


@register("cleanup_text", o.with_articles(
    f"x AS (SELECT UniqueID, {o.s_cleanup('Headline')} AS Headline, {o.s_cleanup('Snippet')} AS Snippet, "
    f"{o.s_cleanup('Abstract')} AS Abstract FROM articles)") + " SELECT * FROM x")
def q_cleanup(spark, sf_dir):
    return articles(spark, sf_dir).select("UniqueID", *[tx.cleanup_text(c).alias(c)
                                                        for c in ("Headline", "Snippet", "Abstract")])


@register("summary_longer_of", o.with_articles(o.cleaned_cte(phrases=[]))
          + " SELECT UniqueID, Summary FROM cleaned")
def q_summary(spark, sf_dir):
    return ft.clean_articles(articles(spark, sf_dir), phrases=[]).select("UniqueID", "Summary")


@register("phrase_collapse", o.with_articles(o.cleaned_cte(phrases=[])) +
          f" SELECT UniqueID, {o.s_mgsub('Text', fx.FIXTURE_PHRASES)} AS Text FROM cleaned")
def q_phrase(spark, sf_dir):
    c = ft.clean_articles(articles(spark, sf_dir), phrases=[])
    return c.select("UniqueID", tx.phrase_collapse("Text", fx.FIXTURE_PHRASES).alias("Text"))


@register("text_concat", o.with_articles(o.cleaned_cte()) + " SELECT UniqueID, Text FROM cleaned")
def q_text_concat(spark, sf_dir):
    return cleaned(spark, sf_dir).select("UniqueID", "Text")


@register("char_counts", o.with_articles(o.cleaned_cte()) +
          " SELECT UniqueID, CAST(length(Headline) AS INTEGER) AS HeadlineCharCount,"
          " CAST(length(Summary) AS INTEGER) AS SummaryCharCount FROM cleaned")
def q_char_counts(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    return c.select("UniqueID", tx.char_count("Headline").alias("HeadlineCharCount"),
                    tx.char_count("Summary").alias("SummaryCharCount"))


@register("word_counts", f"SELECT doc_id, {o.s_word_count('text')} AS word_count FROM documents")
def q_word_counts(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", tx.word_count("text").alias("word_count"))


@register("log_wordcount", o.with_articles(
    f"x AS (SELECT UniqueID, WordCount, {s_r6('ln(1 + CAST(WordCount AS DOUBLE))', 'LogWC')} FROM articles)")
    + " SELECT * FROM x")
def q_logwc(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("UniqueID", "WordCount", F.round(tx.log1p_count("WordCount"), 6).alias("LogWC"))


@register("calendar_parts", o.with_articles(
    "x AS (SELECT UniqueID, strftime(CAST(PubDate AS DATE), '%Y-%m-%d') AS PubDay,"
    " CAST(dayofweek(PubDate) AS INTEGER) AS Weekday, CAST(hour(PubDate) AS INTEGER) AS Hour,"
    " dayname(PubDate) AS DayOfWeek, CAST((dayofweek(PubDate) + 6) % 7 AS INTEGER) AS DayOfWeekOrder,"
    " CAST(dayofyear(PubDate) - 1 AS INTEGER) AS YearDay FROM articles)") + " SELECT * FROM x")
def q_calendar(spark, sf_dir):
    from newsfeat.functions import calendar as cal
    a = ft.add_day_of_week(ft.add_calendar(articles(spark, sf_dir)))
    return a.select("UniqueID", day_str("PubDay"), "Weekday", "Hour", "DayOfWeek", "DayOfWeekOrder",
                    cal.year_day0(F.col("PubDate")).alias("YearDay"))


@register("holiday_flags", o.with_articles(
    f"x AS (SELECT UniqueID, {o.s_holiday('PubDate')} AS Holiday, {o.s_before_holiday('PubDate')} AS BeforeHoliday"
    " FROM articles)") + " SELECT * FROM x")
def q_holiday(spark, sf_dir):
    from newsfeat.functions import calendar as cal
    a = articles(spark, sf_dir)
    return a.select("UniqueID", cal.holiday_flag(F.col("PubDate")).alias("Holiday"),
                    cal.before_holiday_flag(F.col("PubDate")).alias("BeforeHoliday"))


# ------------------------------------------------------------ 2.2 rules
CAT = "UniqueID, NewsDesk, SectionName, SubsectionName"


@register("fill_desk_from_section", o.with_articles(o.cleaned_cte(), o.rules_ctes(upto="r1"))
          + f" SELECT {CAT} FROM r1")
def q_fill_desk(spark, sf_dir):
    return rules.fill_desk_from_section(cleaned(spark, sf_dir)).select(*CAT.split(", "))


@register("masked_update", o.with_articles(o.cleaned_cte(), o.rules_ctes(upto="r3"))
          + f" SELECT {CAT} FROM r3")
def q_masked(spark, sf_dir):
    df = rules.fill_desk_from_section(cleaned(spark, sf_dir))
    df = rules.apply_category_rule(df, fixed.PUZZLES_RULE)
    df = rules.apply_category_rule(df, fixed.STYLE_RULE)
    return df.select(*CAT.split(", "))


@register("fill_section_from_desk", o.with_articles(o.cleaned_cte(), o.rules_ctes(upto="r4"))
          + f" SELECT {CAT} FROM r4")
def q_fill_section(spark, sf_dir):
    df = rules.fill_desk_from_section(cleaned(spark, sf_dir))
    df = rules.apply_category_rule(df, fixed.PUZZLES_RULE)
    df = rules.apply_category_rule(df, fixed.STYLE_RULE)
    return rules.fill_section_from_desk(df).select(*CAT.split(", "))


@register("regex_rule_fill", o.with_articles(o.cleaned_cte(), o.rules_ctes(upto="r7", **RULE_KW))
          + f" SELECT {CAT} FROM r7")
def q_regex_rule(spark, sf_dir):
    df = rules.fill_desk_from_section(cleaned(spark, sf_dir))
    df = rules.apply_category_rule(df, fixed.PUZZLES_RULE)
    df = rules.apply_category_rule(df, fixed.STYLE_RULE)
    df = rules.fill_section_from_desk(df)
    return rules.politics_rules(df, headline_prefixes=fx.FIXTURE_POLITICS_PREFIXES).select(*CAT.split(", "))


@register("fill_missing", o.with_articles(o.cleaned_cte(), o.rules_ctes(**RULE_KW))
          + f" SELECT {CAT} FROM filled")
def q_fill_missing(spark, sf_dir):
    return filled(spark, sf_dir).select(*CAT.split(", "))


@register("label_display", o.with_articles(
    "x AS (SELECT UniqueID, coalesce(CAST(Popular AS VARCHAR), 'N/A') AS Pop FROM articles)") + " SELECT * FROM x")
def q_label_display(spark, sf_dir):
    return articles(spark, sf_dir).select("UniqueID", ft.label_display().alias("Pop"))


# ------------------------------------------------------------ flags
FIXTURE_FLAG_SPECS = fx.fixture_flag_specs()


@register("headline_flags", o.with_articles(o.cleaned_cte(), o.rules_ctes(**RULE_KW),
                                            o.features_cte(flags=FIXTURE_FLAG_SPECS))
          + " SELECT UniqueID, SEO, " + ", ".join(f.name for f in FIXTURE_FLAG_SPECS)
          + ", Holiday, BeforeHoliday FROM feat")
def q_headline_flags(spark, sf_dir):
    df = ft.add_flags(filled(spark, sf_dir), FIXTURE_FLAG_SPECS)
    return df.select("UniqueID", *ft.flag_columns(FIXTURE_FLAG_SPECS))


@register("reference_flags", o.with_articles(o.cleaned_cte(), o.rules_ctes(**RULE_KW), o.features_cte())
          + " SELECT UniqueID, " + ", ".join(ft.flag_columns()) + " FROM feat")
def q_reference_flags(spark, sf_dir):
    df = ft.add_flags(filled(spark, sf_dir))
    return df.select("UniqueID", *ft.flag_columns())


# ------------------------------------------------------------ 2.3 / 2.4 counts
@register("daily_counts", FEATURE_SQL_PREFIX + f" SELECT UniqueID, {s_day_str()}, NumDailyArticles FROM featc")
def q_daily(spark, sf_dir):
    df = tm.with_count(features(spark, sf_dir, counts=False), ["PubDay"], "NumDailyArticles")
    return df.select("UniqueID", day_str(), "NumDailyArticles")


@register("daily_section_counts", FEATURE_SQL_PREFIX
          + f" SELECT UniqueID, {s_day_str()}, SectionName, NumDailySectionArticles FROM featc")
def q_daily_section(spark, sf_dir):
    df = tm.with_count(features(spark, sf_dir, counts=False), ["PubDay", "SectionName"], "NumDailySectionArticles")
    return df.select("UniqueID", day_str(), "SectionName", "NumDailySectionArticles")


@register("hourly_counts", FEATURE_SQL_PREFIX
          + f" SELECT UniqueID, {s_day_str()}, Hour, NumHourlyArticles FROM featc")
def q_hourly(spark, sf_dir):
    df = tm.with_count(features(spark, sf_dir, counts=False), ["PubDay", "Hour"], "NumHourlyArticles")
    return df.select("UniqueID", day_str(), "Hour", "NumHourlyArticles")


@register("temporal_counts", FEATURE_SQL_PREFIX
          + f" SELECT UniqueID, {s_day_str()}, SectionName, Hour, NumDailyArticles, NumDailySectionArticles,"
            " NumHourlyArticles FROM featc")
def q_temporal(spark, sf_dir):
    return features(spark, sf_dir).select("UniqueID", day_str(), "SectionName", "Hour", "NumDailyArticles",
                                          "NumDailySectionArticles", "NumHourlyArticles")


def _dense_sql(row: str, col: str) -> str:
    return FEATURE_SQL_PREFIX + f""",
rl AS (SELECT DISTINCT {row} FROM feat WHERE {row} IS NOT NULL AND {col} IS NOT NULL),
cl AS (SELECT DISTINCT {col} FROM feat WHERE {row} IS NOT NULL AND {col} IS NOT NULL),
cnt AS (SELECT {row}, {col}, count(*) AS n FROM feat WHERE {row} IS NOT NULL AND {col} IS NOT NULL GROUP BY ALL)
SELECT strftime(rl.{row}, '%Y-%m-%d') AS {row}, cl.{col}, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM rl CROSS JOIN cl LEFT JOIN cnt ON rl.{row} = cnt.{row} AND cl.{col} = cnt.{col}"""


@register("day_section_dense", _dense_sql("PubDay", "SectionName"))
def q_day_section_dense(spark, sf_dir):
    d = tm.dense_counts(features(spark, sf_dir, counts=False), "PubDay", "SectionName")
    return d.select(day_str(), "SectionName", "n")


@register("day_hour_dense", _dense_sql("PubDay", "Hour"))
def q_day_hour_dense(spark, sf_dir):
    d = tm.dense_counts(features(spark, sf_dir, counts=False), "PubDay", "Hour")
    return d.select(day_str(), "Hour", "n")


@register("hour_popularity", FEATURE_SQL_PREFIX + """
SELECT Hour, count(*) FILTER (WHERE Popular = 0) AS Unpopular, count(*) FILTER (WHERE Popular = 1) AS Popular,
       round(CAST(count(*) FILTER (WHERE Popular = 1) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE Popular = 0) + count(*) FILTER (WHERE Popular = 1), 0), 6) AS PopularDensity
FROM feat WHERE Hour IS NOT NULL GROUP BY Hour""")
def q_hour_popularity(spark, sf_dir):
    h = tm.hour_popularity(features(spark, sf_dir, counts=False))
    return h.select("Hour", "Unpopular", "Popular", r6("PopularDensity"))


MODEL_FRAME_DOUBLES = {"LogWC"}


def _model_frame_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in fixed.MODEL_DROP_COLUMNS]


@register("model_frame", None)
def q_model_frame(spark, sf_dir):
    df = ft.model_frame(features(spark, sf_dir))
    return df.select(*[r6(c) if c in MODEL_FRAME_DOUBLES else c for c in df.columns])


def _model_frame_sql() -> str:
    # Column list taken from the Spark plan's schema contract (same names, same order).
    cols = (["UniqueID", "NewsDesk", "SectionName", "SubsectionName", "Popular", "Weekday", "Hour"]
            + ["LogWC", "HeadlineCharCount", "SummaryCharCount", "HeadlineWordCount", "SummaryWordCount", "Pop"]
            + ft.flag_columns() + ["DayOfWeek", "DayOfWeekOrder",
                                   "NumDailyArticles", "NumDailySectionArticles", "NumHourlyArticles"])
    sel = ", ".join(s_r6(c, c) if c in MODEL_FRAME_DOUBLES else c for c in cols)
    return FEATURE_SQL_PREFIX + f" SELECT {sel} FROM featc"


REGISTRY["model_frame"].sql = _model_frame_sql()


# ------------------------------------------------------------ events (J1, C10)
@register("events_daily_counts", """
WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day FROM events),
d AS (SELECT day, count(*) AS NumDailyEvents FROM e WHERE day IS NOT NULL GROUP BY day)
SELECT e.event_id, strftime(e.day, '%Y-%m-%d') AS day, d.NumDailyEvents FROM e LEFT JOIN d ON e.day = d.day""")
def q_events_daily(spark, sf_dir):
    e = tables.events(spark, sf_dir, ["event_id", "ts"]).select("event_id", F.to_date("ts").alias("day"))
    return tm.with_count(e, ["day"], "NumDailyEvents").select("event_id", day_str("day"), "NumDailyEvents")


@register("label_series", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, count(*) AS n
FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL""")
def q_label_series(spark, sf_dir):
    e = tables.events(spark, sf_dir, ["ts", "event_type"]).select(F.to_date("ts").alias("day"), "event_type")
    return tm.count_by(e, ["day", "event_type"], "n").select(day_str("day"), "event_type", "n")


# ------------------------------------------------------------ 2.9 text mining

STOP = fx.FIXTURE_STOPWORDS


def doc_corpus(spark, sf_dir, n_min=1, n_max=1):
    return tmx.corpus(tables.documents(spark, sf_dir), "doc_id", "text", STOP, n_min, n_max)


def article_corpus(spark, sf_dir, field, n_min=1, n_max=1, stemmed=False):
    from newsfeat.functions.stem import stemmer
    return tmx.corpus(cleaned(spark, sf_dir), "UniqueID", field, STOP, n_min, n_max,
                      stemmer if stemmed else None)


def article_tokens(spark, sf_dir, field, stemmed=False):
    """Cleaned tokens of a field, written once: they are read for the vocabulary and again for the counts."""
    from newsfeat.functions.stem import stemmer
    return written_table(tmx.corpus_tokens(cleaned(spark, sf_dir), "UniqueID", field, STOP, stemmer if stemmed else None), "tokens")


DOCS_SRC = "SELECT doc_id, text FROM documents"


def _doc_corpus_sql(n_min=1, n_max=1, prefix=""):
    return o.corpus_ctes(DOCS_SRC, "doc_id", "text", STOP, n_min, n_max, prefix)


def _article_corpus_sql(field, n_min=1, n_max=1, prefix=""):
    return o.corpus_ctes("SELECT * FROM cleaned", "UniqueID", field, STOP, n_min, n_max, prefix)


@register("tokens_clean", f"WITH {o.corpus_ctes(DOCS_SRC, 'doc_id', 'text', STOP).strip()} "
          "SELECT doc_id, array_to_string(tokens, ' ') AS clean_text FROM toks")
def q_tokens_clean(spark, sf_dir):
    d = tables.documents(spark, sf_dir)
    return d.select("doc_id", F.array_join(tmx.clean_tokens(F.col("text"), STOP), " ").alias("clean_text"))


@register("doc_term_counts", f"WITH {_doc_corpus_sql().strip()} SELECT doc_id, term, tf FROM tc")
def q_doc_term_counts(spark, sf_dir):
    return tmx.term_counts(doc_corpus(spark, sf_dir)).select("doc_id", "term", "tf")


@register("ngrams_1_3", f"WITH {_doc_corpus_sql(1, 3).strip()} SELECT doc_id, term, tf FROM tc")
def q_ngrams(spark, sf_dir):
    return tmx.term_counts(doc_corpus(spark, sf_dir, 1, 3)).select("doc_id", "term", "tf")


@register("remove_sparse_terms", f"WITH {_doc_corpus_sql().strip()} SELECT term, df FROM dfreq, ndocs "
          f"WHERE {o.s_keep_dense('df', 'n', fixed.SPARSITY_TEXT)}")
def q_remove_sparse(spark, sf_dir):
    corp = doc_corpus(spark, sf_dir)
    n = tmx.n_docs(corp)
    return tmx.keep_dense_terms(tmx.corpus_frequency(corp), n, fixed.SPARSITY_TEXT)


def _tfidf_sql(select: str) -> str:
    return o.with_articles(o.cleaned_cte(), _article_corpus_sql("Text", fixed.NGRAM_MIN, fixed.NGRAM_MAX)) + f""",
kept AS (SELECT term, df FROM dfreq, ndocs WHERE {o.s_keep_dense('df', 'n', fixed.SPARSITY_TEXT)}),
w AS (SELECT tc.doc_id, tc.term, tc.tf, kept.df,
             CAST(tc.tf AS DOUBLE) / tc.doc_total * log2(CAST((SELECT n FROM ndocs) AS DOUBLE) / kept.df) AS weight
      FROM tc JOIN kept ON tc.term = kept.term)
{select}"""


def article_tfidf(spark, sf_dir, stemmed=False):
    toks = article_tokens(spark, sf_dir, "Text", stemmed)
    return tmx.dense_tfidf(toks, tmx.n_docs(toks), fixed.SPARSITY_TEXT, fixed.NGRAM_MIN, fixed.NGRAM_MAX)


@register("tfidf", _tfidf_sql("SELECT doc_id, term, tf, df, round(weight, 6) AS weight FROM w"))
def q_tfidf(spark, sf_dir):
    return article_tfidf(spark, sf_dir).select("doc_id", "term", "tf", "df", r6("weight"))


@register("tfidf_frequent_terms", _tfidf_sql(
    f"SELECT term, round(sum(weight), 6) AS freq FROM w GROUP BY term HAVING sum(weight) >= {fx.FIXTURE_TEXT_MIN_WEIGHT}"))
def q_tfidf_frequent(spark, sf_dir):
    w = article_tfidf(spark, sf_dir)
    return tmx.frequent_terms(w, fx.FIXTURE_TEXT_MIN_WEIGHT, "weight").select("term", r6("freq"))


def _headline_freq_sql(select: str) -> str:
    return o.with_articles(o.cleaned_cte(), _article_corpus_sql("Headline")) + f""",
fr AS (SELECT term, CAST(sum(tf) AS BIGINT) AS freq FROM tc GROUP BY term HAVING sum(tf) >= {fixed.FREQ_TERMS_HEADLINE_MIN})
{select}"""


def headline_frequent(spark, sf_dir):
    tc = tmx.term_counts(article_corpus(spark, sf_dir, "Headline"))
    return tmx.frequent_terms(tc, fixed.FREQ_TERMS_HEADLINE_MIN)


@register("frequent_terms", _headline_freq_sql("SELECT term, freq FROM fr"))
def q_frequent_terms(spark, sf_dir):
    return headline_frequent(spark, sf_dir)


@register("ordered_bars", _headline_freq_sql(
    "SELECT term, freq, row_number() OVER (ORDER BY freq, term) AS bar_order FROM fr"))
def q_ordered_bars(spark, sf_dir):
    return tmx.ordered_bars(headline_frequent(spark, sf_dir)).select("term", "freq", F.col("bar_order").cast("long"))


def _lang_totals_sql() -> str:
    return f"""WITH lt AS (
  SELECT lang, term, count(*) AS freq FROM (
    SELECT lang, unnest({o.s_long_terms(o.s_clean_tokens('text', STOP))}) AS term FROM documents)
  GROUP BY lang, term),
rk AS (SELECT lang, term, freq, row_number() OVER (PARTITION BY lang ORDER BY freq DESC, term) AS rank FROM lt)"""


def lang_term_totals(spark, sf_dir):
    d = tables.documents(spark, sf_dir, ["doc_id", "text", "lang"])
    terms = tmx.long_terms(tmx.clean_tokens(F.col("text"), STOP))
    return (d.select("lang", tmx.explode_terms(terms).alias("term")).where(F.col("term").isNotNull())
             .groupBy("lang", "term").agg(F.count(F.lit(1)).alias("freq")))


@register("top_terms_per_group", _lang_totals_sql() +
          f" SELECT lang, term, freq, rank FROM rk WHERE rank <= {fixed.TOP_TERMS_PER_CLUSTER}")
def q_top_terms_per_group(spark, sf_dir):
    top = tmx.top_terms_per_group(lang_term_totals(spark, sf_dir), "lang", fixed.TOP_TERMS_PER_CLUSTER)
    return top.select("lang", "term", "freq", F.col("rank").cast("long"))


@register("top_terms_concat", _lang_totals_sql() +
          f" SELECT lang, string_agg(term, ', ' ORDER BY rank) AS terms FROM rk WHERE rank <= {fixed.TOP_TERMS_PER_TOPIC}"
          " GROUP BY lang")
def q_top_terms_concat(spark, sf_dir):
    top = tmx.top_terms_per_group(lang_term_totals(spark, sf_dir), "lang", fixed.TOP_TERMS_PER_TOPIC)
    return tmx.concat_ranked(top, "lang")


@register("bow_features", o.with_articles(
    o.cleaned_cte(), _article_corpus_sql("Headline", prefix="h_"), _article_corpus_sql("Summary", prefix="s_")) + f"""
SELECT doc_id, {o.s_sanitize_names('H', 'h_tc.term')} AS feature, h_tc.tf AS value
FROM h_tc JOIN h_dfreq USING (term), h_ndocs WHERE {o.s_keep_dense('h_dfreq.df', 'h_ndocs.n', fixed.SPARSITY_HEADLINE)}
UNION ALL
SELECT doc_id, {o.s_sanitize_names('S', 's_tc.term')} AS feature, s_tc.tf AS value
FROM s_tc JOIN s_dfreq USING (term), s_ndocs WHERE {o.s_keep_dense('s_dfreq.df', 's_ndocs.n', fixed.SPARSITY_SUMMARY)}""")
def q_bow(spark, sf_dir):
    h = article_tokens(spark, sf_dir, "Headline")
    s = article_tokens(spark, sf_dir, "Summary")
    nh, ns = tmx.n_docs(h), tmx.n_docs(s)
    return tmx.bag_of_words(tmx.remove_sparse_terms(h, nh, fixed.SPARSITY_HEADLINE),
                            tmx.remove_sparse_terms(s, ns, fixed.SPARSITY_SUMMARY))


BOW_CATEGORIES = {"Hour", "Weekday"}


def _bow_frame_sql() -> str:
    level = [c for c in fixed.BOW_EXTRA_COLUMNS if c in BOW_CATEGORIES | {"NewsDesk", "SectionName", "SubsectionName"}]
    meta = " UNION ALL ".join(
        f"SELECT UniqueID AS doc_id, '{c}' AS feature, {'CAST(NULL AS DOUBLE)' if c in level else f'round(CAST({c} AS DOUBLE), 6)'} AS number, "
        f"{f'CAST({c} AS VARCHAR)' if c in level else 'CAST(NULL AS VARCHAR)'} AS level FROM featc" for c in fixed.BOW_EXTRA_COLUMNS)
    return (f"SELECT doc_id, feature, CAST(value AS DOUBLE) AS number, CAST(NULL AS VARCHAR) AS level FROM ({REGISTRY['bow_features'].sql}) "
            f"UNION ALL SELECT * FROM ({FEATURE_SQL_PREFIX} {meta})")


@register("bow_frame", _bow_frame_sql())
def q_bow_frame(spark, sf_dir):
    """Headline and summary terms bound to the 14 metadata columns."""
    out = tmx.bind_columns(q_bow(spark, sf_dir), ft.model_frame(features(spark, sf_dir)), fixed.BOW_EXTRA_COLUMNS, "UniqueID",
                           BOW_CATEGORIES)
    return out.select("doc_id", "feature", r6("number"), "level")


# ------------------------------------------------------------ 2.12 evaluation

SCORED_SQL = """WITH scored AS (
  SELECT d.doc_id, l.quality AS truth,
         CAST(d.n_chars AS DOUBLE) / (CAST(d.n_chars AS DOUBLE) + 2000.0) AS score
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def scored_docs(spark, sf_dir):
    """Labelled documents with a deterministic length score in [0, 1)."""
    d = tables.documents(spark, sf_dir, ["doc_id", "n_chars"], spread_rows=False)
    lab = tables.labels(spark, sf_dir, ["doc_id", "quality"])
    return d.join(lab, "doc_id").select(
        "doc_id", F.col("quality").alias("truth"),
        (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("score"))


@register("accuracy", SCORED_SQL + f"""
SELECT round(avg(CASE WHEN truth = CAST(score > {fixed.PROBABILITY_THRESHOLD} AS INTEGER) THEN 1.0 ELSE 0.0 END), 6)
       AS accuracy, count(*) AS n
FROM scored WHERE truth IS NOT NULL AND score IS NOT NULL""")
def q_accuracy(spark, sf_dir):
    return ev.accuracy(scored_docs(spark, sf_dir)).select(r6("accuracy"), "n")


@register("confusion", SCORED_SQL + f"""
SELECT CAST(truth AS INTEGER) AS truth, CAST(score > {fixed.PROBABILITY_THRESHOLD} AS INTEGER) AS predicted, count(*) AS n
FROM scored WHERE truth IS NOT NULL AND score IS NOT NULL GROUP BY ALL""")
def q_confusion(spark, sf_dir):
    return ev.confusion(scored_docs(spark, sf_dir))


AUC_SQL_TAIL = """,
g AS (SELECT score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg
      FROM scored WHERE truth IS NOT NULL AND score IS NOT NULL GROUP BY score),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             AS neg_below FROM g)
SELECT round(sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


@register("auc", SCORED_SQL + AUC_SQL_TAIL)
def q_auc(spark, sf_dir):
    return ev.auc(scored_docs(spark, sf_dir)).select(r6("auc"), "n_pos", "n_neg")


# Deterministic stand-ins for the six models' probabilities, derived from the
# article features (the blend arithmetic is what is checked here).
STANDIN_SCORES = {
    "rfCustomSel": ("HeadlineCharCount", 50.0),
    "rfCustomSelKMC": ("SummaryCharCount", 150.0),
    "rfCustomSelLDA": ("LogWC", 5.0),
    "rfBoW": ("HeadlineWordCount", 8.0),
    "log": ("NumDailyArticles", 8.0),
}


def standin_predictions(spark, sf_dir) -> DataFrame:
    test = features(spark, sf_dir).where(F.col("Popular").isNull())
    # Each model has no score for a share of the ids, so that missing predictions are checked too.
    wide = test.select("UniqueID", *[F.when(F.col("UniqueID") % 29 != i, F.col(c).cast("double") / (
        F.col(c).cast("double") + F.lit(k))).alias(m) for i, (m, (c, k)) in enumerate(STANDIN_SCORES.items())])
    return bl.unpivot_predictions(wide, {m: m for m in STANDIN_SCORES})


def _standin_sql() -> str:
    sel = " UNION ALL ".join(
        f"SELECT {o.q(m)} AS model, UniqueID, CASE WHEN UniqueID % 29 <> {i} THEN CAST({c} AS DOUBLE) / (CAST({c} AS DOUBLE) + {k!r}) END AS p "
        f"FROM featc WHERE Popular IS NULL" for i, (m, (c, k)) in enumerate(STANDIN_SCORES.items()))
    return FEATURE_SQL_PREFIX + f",\npreds AS ({sel})"


def _blend_sql(blends: dict) -> str:
    rows = []
    for name, ws in blends.items():
        merged = bl._merge_weights(ws)
        tot = sum(merged.values())
        for m, w in merged.items():
            rows.append(f"({o.q(name)}, {o.q(m)}, {w!r}, {tot!r}, {len(merged)})")
    return f"""wt(blend, model, w, tot, k) AS (VALUES {', '.join(rows)}),
agg AS (SELECT wt.blend, p.UniqueID, count(p.p) AS m, sum(wt.w * p.p) AS s, max(wt.tot) AS tot,
               max(wt.k) AS k
        FROM preds p JOIN wt ON p.model = wt.model GROUP BY wt.blend, p.UniqueID)"""


ALL_BLENDS = {**fixed.BLENDS, **fixed.BLEND_AS_WRITTEN}


@register("blend", _standin_sql() + ",\n" + _blend_sql(ALL_BLENDS) +
          " SELECT blend, UniqueID, round(CASE WHEN m = k THEN s / tot END, 6) AS Probability1 FROM agg")
def q_blend(spark, sf_dir):
    out = bl.all_blends(standin_predictions(spark, sf_dir), ALL_BLENDS)
    return out.select("blend", "UniqueID", r6("Probability1"))


@register("submission", _standin_sql() + ",\n" + _blend_sql(fixed.BLENDS) +
          " SELECT blend || 'Pred' AS name, UniqueID, round(CASE WHEN m = k THEN s / tot END, 6) AS Probability1 FROM agg"
          " UNION ALL SELECT model || 'Pred' AS name, UniqueID, round(p, 6) AS Probability1 FROM preds")
def q_submission(spark, sf_dir):
    """All 13 outputs, written in one go and read back."""
    path = shared_path(spark, fixed.SUBMISSION_PREFIX + "all")
    csvio.write_named(bl.submissions(standin_predictions(spark, sf_dir)), path)
    return csvio.read_named(spark, path, csvio.SUBMISSION_SCHEMA).select("name", "UniqueID", r6("Probability1"))


# ------------------------------------------------------------ 2.13 chart data
def _kde_sql(x: str, group: str, facet: str | None, where: str, n_grid: int = charts.N_GRID) -> str:
    keys = ([facet] if facet else []) + [group]
    k = ", ".join(keys)
    kb = ", ".join(f"b.{c}" for c in keys)
    on = " AND ".join(f"b.{c} = s.{c}" for c in keys)
    sqrt2pi = repr(__import__("math").sqrt(2 * __import__("math").pi))
    return FEATURE_SQL_PREFIX + f""",
src AS (SELECT {k}, CAST({x} AS DOUBLE) AS x FROM featc WHERE {x} IS NOT NULL AND {where}),
prm AS (SELECT min(x) AS lo, CASE WHEN max(x) > min(x) THEN (max(x) - min(x)) / {n_grid - 1} ELSE 1.0 END AS delta FROM src),
st0 AS (SELECT {k}, count(*) AS n, coalesce(stddev_samp(x), 0.0) AS sd, quantile_cont(x, 0.25) AS q1,
               quantile_cont(x, 0.75) AS q3, min(abs(x)) AS absx FROM src GROUP BY ALL),
st AS (SELECT {k}, n, 0.9 * (CASE WHEN least(sd, (q3 - q1) / 1.34) > 0 THEN least(sd, (q3 - q1) / 1.34)
                                  WHEN sd > 0 THEN sd WHEN absx > 0 THEN absx ELSE 1.0 END)
                      * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st0),
pos AS (SELECT {k}, (x - lo) / delta AS p FROM src, prm),
b2 AS (SELECT {k}, CAST(floor(p) AS INTEGER) AS bin, 1.0 - (p - floor(p)) AS w FROM pos
       UNION ALL SELECT {k}, CAST(floor(p) AS INTEGER) + 1 AS bin, p - floor(p) AS w FROM pos),
bins AS (SELECT {k}, bin, sum(w) AS w FROM b2 WHERE bin >= 0 AND bin < {n_grid} AND w > 0 GROUP BY ALL),
dens AS (SELECT {kb}, g.i, sum(b.w * exp(-0.5 * ((g.i - b.bin) * prm.delta / s.bw) * ((g.i - b.bin) * prm.delta / s.bw)))
                / (max(s.n) * max(s.bw) * {sqrt2pi}) AS density, max(prm.lo) + g.i * max(prm.delta) AS x
         FROM bins b JOIN st s ON {on}, prm, (SELECT range AS i FROM range(0, {n_grid})) g GROUP BY {kb}, g.i)
SELECT {k}, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(density, 6) AS density,
       round(density / nullif(max(density) OVER (PARTITION BY {k}), 0), 6) AS scaled FROM dens"""


def _kde(spark, sf_dir, x, group, facet, labelled_only):
    df = features(spark, sf_dir)
    if labelled_only:
        df = df.where(F.col("Popular").isNotNull())
    d = charts.scaled_density(df, x, group, facet)
    keys = ([facet] if facet else []) + [group]
    return d.select(*keys, "i", r6("x"), r6("density"), r6("scaled"))


@register("kde_by_group", _kde_sql("LogWC", "Popular", None, "Popular IS NOT NULL"))
def q_kde(spark, sf_dir):
    return _kde(spark, sf_dir, "LogWC", "Popular", None, True)


@register("kde_by_group_facet", _kde_sql("LogWC", "Popular", "DayOfWeek", "Popular IS NOT NULL"))
def q_kde_facet(spark, sf_dir):
    return _kde(spark, sf_dir, "LogWC", "Popular", "DayOfWeek", True)


@register("kde_daily_articles", _kde_sql("NumDailyArticles", "Pop", None, "TRUE"))
def q_kde_daily(spark, sf_dir):
    return _kde(spark, sf_dir, "NumDailyArticles", "Pop", None, False)


@register("kde_headline_chars", _kde_sql("HeadlineCharCount", "Popular", None, "Popular IS NOT NULL"))
def q_kde_headline_chars(spark, sf_dir):
    return _kde(spark, sf_dir, "HeadlineCharCount", "Popular", None, True)


@register("kde_headline_words", _kde_sql("HeadlineWordCount", "Popular", None, "Popular IS NOT NULL"))
def q_kde_headline_words(spark, sf_dir):
    return _kde(spark, sf_dir, "HeadlineWordCount", "Popular", None, True)


@register("kde_daily_section_facet", _kde_sql("NumDailySectionArticles", "Popular", "SectionName", "Popular IS NOT NULL"))
def q_kde_daily_section(spark, sf_dir):
    return _kde(spark, sf_dir, "NumDailySectionArticles", "Popular", "SectionName", True)


@register("kde_hourly_facet", _kde_sql("NumHourlyArticles", "Popular", "Hour", "Popular IS NOT NULL"))
def q_kde_hourly(spark, sf_dir):
    return _kde(spark, sf_dir, "NumHourlyArticles", "Popular", "Hour", True)


@register("ordered_bars_text", _tfidf_sql(
    "SELECT term, round(freq, 6) AS freq, row_number() OVER (ORDER BY round(freq, 6), term) AS bar_order FROM "
    f"(SELECT term, sum(weight) AS freq FROM w GROUP BY term HAVING sum(weight) >= {fx.FIXTURE_TEXT_MIN_WEIGHT})"))
def q_ordered_bars_text(spark, sf_dir):
    w = tmx.frequent_terms(article_tfidf(spark, sf_dir), fx.FIXTURE_TEXT_MIN_WEIGHT, "weight").select("term", r6("freq"))
    return tmx.ordered_bars(w).select("term", "freq", F.col("bar_order").cast("long"))


def _chart_sql() -> str:
    parts = []
    for name, (x, group, facet, labelled) in pipeline.DENSITY_CHARTS.items():
        inner = _kde_sql(x, group, facet, "Popular IS NOT NULL" if labelled else "TRUE")
        parts.append(f"SELECT '{name}' AS name, CAST({facet or 'NULL'} AS VARCHAR) AS facet, CAST({group} AS VARCHAR) AS series, "
                     f"i, x, scaled AS y FROM ({inner})")
    for name in ("ordered_bars", "ordered_bars_text"):
        parts.append(f"SELECT '{name}' AS name, NULL AS facet, term AS series, CAST(bar_order AS INTEGER) AS i, "
                     f"CAST(NULL AS DOUBLE) AS x, round(CAST(freq AS DOUBLE), 6) AS y FROM ({REGISTRY[name].sql})")
    return " UNION ALL ".join(parts)


@register("chart_data", _chart_sql())
def q_chart_data(spark, sf_dir):
    """The series of the charts that need no model, written in one go and read back."""
    bars = {n: REGISTRY[n].run(spark, sf_dir) for n in ("ordered_bars", "ordered_bars_text")}
    path = shared_path(spark, "charts")
    csvio.write_named(pipeline.chart_series(features(spark, sf_dir), bars), path, "parquet")
    schema = spark.createDataFrame([], pipeline.CHART_SCHEMA).schema
    return csvio.read_named(spark, path, schema, "parquet").select("name", "facet", "series", "i", r6("x"), r6("y"))


@register("tfidf_term_totals", _tfidf_sql("SELECT term, round(sum(weight), 6) AS freq FROM w GROUP BY term"))
def q_tfidf_totals(spark, sf_dir):
    return tmx.term_totals(article_tfidf(spark, sf_dir), "weight").select("term", r6("freq"))


# ------------------------------------------------------------ 2.10 topics

SEED = 1


def kmeans_result(spark, sf_dir):
    w = article_tfidf(spark, sf_dir, stemmed=True).select("doc_id", "term", F.col("weight").alias("w"))
    docs = articles(spark, sf_dir).select(F.col("UniqueID").alias("doc_id"))
    return tp.kmeans(w, fixed.N_CLUSTERS, 10, SEED, docs)


@register("kmeans_topics")
def q_kmeans(spark, sf_dir):
    assign, _ = kmeans_result(spark, sf_dir)
    return assign.select(F.col("doc_id").alias("UniqueID"), F.col("cluster").alias("TopicCluster"))


@register("cluster_top_terms")
def q_cluster_top_terms(spark, sf_dir):
    _, centers = kmeans_result(spark, sf_dir)
    top = tp.center_top_terms(centers, fixed.TOP_TERMS_PER_CLUSTER)
    return tmx.concat_ranked(top, "cluster")


def lda_result(spark, sf_dir):
    corp = article_corpus(spark, sf_dir, "Text", stemmed=True)
    return lda.lda_topics(corp, fixed.N_TOPICS, seed=SEED, n_terms=fixed.TOP_TERMS_PER_TOPIC)


@register("lda_topics")
def q_lda(spark, sf_dir):
    doc_topics, _ = lda_result(spark, sf_dir)
    return doc_topics.select(F.col("doc_id").alias("UniqueID"), F.col("topic").alias("Topic"), "prob")


@register("lda_topic_terms")
def q_lda_terms(spark, sf_dir):
    return lda_result(spark, sf_dir)[1]


def topic_series(spark, sf_dir):
    doc_topics, terms = lda_result(spark, sf_dir)
    days = articles(spark, sf_dir).select(F.col("UniqueID").alias("doc_id"), F.to_date("PubDate").alias("date"))
    # k topic rows: broadcast size is bounded by the topic count.
    return days.join(doc_topics, "doc_id").join(F.broadcast(terms), "topic", "left")


@register("topic_series")
def q_topic_series(spark, sf_dir):
    return topic_series(spark, sf_dir).select(F.col("doc_id").alias("UniqueID"), day_str("date"), "topic", "terms")


@register("topic_density")
def q_topic_density(spark, sf_dir):
    ts = topic_series(spark, sf_dir).where(F.col("topic").isNotNull()).withColumn(
        "day_num", F.datediff("date", F.lit("1970-01-01").cast("date")))
    d = charts.scaled_density(ts, "day_num", "terms")
    counts = ts.groupBy("terms").agg(F.count(F.lit(1)).alias("n"))
    return d.join(counts, "terms").select("terms", "i", F.date_add(F.lit("1970-01-01").cast("date"),
                                                                   F.floor("x").cast("int")).alias("date"),
                                          (F.col("density") * F.col("n")).alias("count"))


def term_profiles(spark, sf_dir):
    """The n-gram TF-IDF terms (sparsity-cut) as rows over documents, columns
    standardised."""
    w = article_tfidf(spark, sf_dir, stemmed=True)
    pts = written_table(w.select(F.col("term").alias("id"), F.col("doc_id").cast("string").alias("feature"),
                                 F.col("weight").alias("w")), "term-profiles")
    return tp.column_scaled(pts, pts.select("id").distinct().count())


@register("term_merges")
def q_term_merges(spark, sf_dir):
    """Bottom-up Ward merges of the terms' clustering features."""
    merges, _ = hierarchy.ward_tree(term_profiles(spark, sf_dir), seed=SEED)
    return merges


@register("term_nodes")
def q_term_nodes(spark, sf_dir):
    """The clustering feature (node of ``term_merges``) of each term."""
    members = hierarchy.nodes(term_profiles(spark, sf_dir), seed=SEED)
    return members.select(F.col("id").alias("term"), "node")


@register("term_hierarchy")
def q_term_hierarchy(spark, sf_dir):
    """Terms of the n-gram TF-IDF matrix (sparsity-cut) clustered top-down over
    their document profiles until no leaf holds two different profiles, columns
    standardised (re-aimed hierarchical
    clustering: the all-pairs distance matrix is never formed)."""
    tree = tp.bisecting_kmeans(term_profiles(spark, sf_dir), seed=SEED)
    return tree.select(F.col("id").alias("term"), "path")


@register("nearest_centroid", """
WITH v AS (SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
                  generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
c AS (SELECT label AS center, dim, avg(x) AS c FROM v WHERE label IS NOT NULL GROUP BY label, dim),
d AS (SELECT v.id, c.center, sum((v.x - c.c) * (v.x - c.c)) AS d2 FROM v JOIN c ON v.dim = c.dim GROUP BY v.id, c.center),
b AS (SELECT id, arg_min(center, (d2, center)) AS center, min(d2) AS d2 FROM d GROUP BY id)
SELECT id AS vec_id, CAST(center AS INTEGER) AS center, round(sqrt(d2), 6) AS dist FROM b""")
def q_nearest_centroid(spark, sf_dir):
    e = tables.embeddings(spark, sf_dir)
    nc = tp.nearest_centroid(e, "vec_id", "embedding", tp.group_centroids(e, "embedding", "label"))
    return nc.select(F.col("id").alias("vec_id"), F.col("center").cast("int").alias("center"), r6("dist"))


# ------------------------------------------------------------ 2.11 models
def model_table(spark, sf_dir, with_kmeans=False, with_lda=False):
    """The modelling table, written once to the shared checkpoint folder: the
    fit (every tree level) and the scoring of unlabelled rows both read it, so
    the regex-heavy feature plan runs a single time."""
    from newsfeat.session import cut_lineage
    df = ft.model_frame(features(spark, sf_dir))
    if with_kmeans:
        assign, _ = kmeans_result(spark, sf_dir)
        df = df.join(assign.select(F.col("doc_id").alias("UniqueID"), F.col("cluster").alias("TopicCluster")),
                     "UniqueID", "left")
    if with_lda:
        doc_topics, _ = lda_result(spark, sf_dir)
        df = df.join(doc_topics.select(F.col("doc_id").alias("UniqueID"), F.col("topic").alias("Topic")),
                     "UniqueID", "left")
    return cut_lineage(df)


NOT_FEATURES = ["DayOfWeekOrder"]
FULL_EXCLUDE = fixed.RF_FULL_EXCLUDE + NOT_FEATURES
SELECTED_EXCLUDE = FULL_EXCLUDE + fixed.RF_SELECTED_EXTRA_EXCLUDE


def _forest_scores(df, exclude):
    cols = md.feature_columns(df, [c for c in exclude if c in df.columns])
    fitted = md.fit(md.random_forest_pipeline(df, cols, seed=SEED), df, cols)
    return md.score(fitted, df.where(F.col("Popular").isNull())).select("UniqueID", "p")


@register("rf_full")
def q_rf_full(spark, sf_dir):
    return _forest_scores(model_table(spark, sf_dir), FULL_EXCLUDE)


@register("rf_selected")
def q_rf_selected(spark, sf_dir):
    return _forest_scores(model_table(spark, sf_dir), SELECTED_EXCLUDE)


@register("rf_kmeans")
def q_rf_kmeans(spark, sf_dir):
    ex = [c for c in SELECTED_EXCLUDE if c != "TopicCluster"]
    return _forest_scores(model_table(spark, sf_dir, with_kmeans=True), ex)


@register("rf_lda")
def q_rf_lda(spark, sf_dir):
    ex = [c for c in SELECTED_EXCLUDE if c != "Topic"]
    return _forest_scores(model_table(spark, sf_dir, with_lda=True), ex)


@register("logistic")
def q_logistic(spark, sf_dir):
    df = model_table(spark, sf_dir)
    cols = fixed.LOGISTIC_PREDICTORS
    fitted = md.fit(md.logistic_pipeline(df, cols), df, cols)
    return md.score(fitted, df.where(F.col("Popular").isNull())).select("UniqueID", "p")


def bow_table(spark, sf_dir):
    """Bag-of-words model table: sparse headline / summary term vectors plus the
    metadata columns (term vectors via CountVectorizer with the sparsity cut as
    its minimum document frequency)."""
    from pyspark.ml.feature import CountVectorizer
    h = article_corpus(spark, sf_dir, "Headline", stemmed=True).withColumnRenamed("terms", "hterms")
    s = article_corpus(spark, sf_dir, "Summary", stemmed=True).withColumnRenamed("terms", "sterms")
    n = tmx.n_docs(h)
    meta = model_table(spark, sf_dir).select("UniqueID", *fixed.BOW_EXTRA_COLUMNS)
    from newsfeat.session import cut_lineage
    j = cut_lineage(meta.join(h.withColumnRenamed("doc_id", "UniqueID"), "UniqueID")
                        .join(s.withColumnRenamed("doc_id", "UniqueID"), "UniqueID"))
    min_h = int(tmx.sparse_threshold(n, fixed.SPARSITY_HEADLINE)) + 1
    min_s = int(tmx.sparse_threshold(n, fixed.SPARSITY_SUMMARY)) + 1
    cap = tp.NO_VOCAB_CAP
    j = CountVectorizer(inputCol="hterms", outputCol="H", minDF=float(min_h), vocabSize=cap).fit(j).transform(j)
    j = CountVectorizer(inputCol="sterms", outputCol="S", minDF=float(min_s), vocabSize=cap).fit(j).transform(j)
    from newsfeat.session import cut_lineage
    return cut_lineage(j.drop("hterms", "sterms"))


@register("rf_bow")
def q_rf_bow(spark, sf_dir):
    df = bow_table(spark, sf_dir)
    cols = ["H", "S"] + [c for c in fixed.BOW_EXTRA_COLUMNS if c != "Popular"]
    fitted = md.fit(md.random_forest_pipeline(df, cols, seed=SEED), df, cols)
    return md.score(fitted, df.where(F.col("Popular").isNull())).select("UniqueID", "p")


def _full_folds(spark, sf_dir):
    df = model_table(spark, sf_dir)
    cols = md.feature_columns(df, FULL_EXCLUDE)
    return md.crossfit(lambda d, c: md.random_forest_pipeline(d, c, seed=SEED), df, cols, 5, SEED)


@register("rf_oob_eval")
def q_rf_eval(spark, sf_dir):
    """Cross-fitted accuracy and AUC of the full-feature forest (OOB stand-in)."""
    oof = md.crossfit_predictions(_full_folds(spark, sf_dir))
    from newsfeat.session import cut_lineage
    # Five forest fits feed two metrics: write the out-of-fold scores once.
    oof = cut_lineage(oof.select("truth", F.col("p").alias("score")))
    a = ev.accuracy(oof).select("accuracy")
    u = ev.auc(oof).select("auc").first()["auc"]
    return a.select("accuracy", F.lit(u).alias("auc"))


@register("permutation_importance")
def q_perm_importance(spark, sf_dir):
    """Out-of-fold importance of the full-feature forest, as ordered bars."""
    signed = md.importance_signed(md.permutation_importance(_full_folds(spark, sf_dir), SEED))
    # Chart order of the importance bars: ascending value, ties by name.
    return tmx.ordered_bars(signed, "value", "X1")


def bagged_forests(spark, sf_dir, names):
    """``{name: (bagged forest, its table)}`` of the script's five forests, by
    name; topics and clusters are worked out once for all that need them."""
    topics = {"with_kmeans": "rfCustomSelKMC" in names, "with_lda": "rfCustomSelLDA" in names}
    frame = model_table(spark, sf_dir, **topics)
    exclude = {"rfCustomFull": FULL_EXCLUDE, "rfCustomSel": SELECTED_EXCLUDE,
               "rfCustomSelKMC": [c for c in SELECTED_EXCLUDE if c != "TopicCluster"],
               "rfCustomSelLDA": [c for c in SELECTED_EXCLUDE if c != "Topic"]}
    out = {}
    for name in names:
        if name == "rfBoW":
            df = bow_table(spark, sf_dir)
            cols = ["H", "S"] + [c for c in fixed.BOW_EXTRA_COLUMNS if c != "Popular"]
        else:
            df, cols = frame, md.feature_columns(frame, exclude[name])
        out[name] = (md.bagged_forest(df, cols, seed=SEED), df)
    return out


CUSTOM_FORESTS = ["rfCustomFull", "rfCustomSel", "rfCustomSelKMC", "rfCustomSelLDA"]


@register("oob_evaluation")
def q_oob_evaluation(spark, sf_dir):
    """Out-of-bag accuracy and AUC of all five forests."""
    from functools import reduce

    from newsfeat.session import written_table
    parts = []
    for name, (forest, df) in bagged_forests(spark, sf_dir, [*CUSTOM_FORESTS, "rfBoW"]).items():
        votes = written_table(md.oob_predictions(forest, df).select("truth", F.col("p").alias("score")), "oob")
        parts.append(ev.accuracy(votes).select("accuracy").crossJoin(ev.auc(votes).select("auc"))  # one row each
                     .select(F.lit(name).alias("model"), "accuracy", "auc"))
    return reduce(DataFrame.unionByName, parts)


@register("oob_importance")
def q_oob_importance(spark, sf_dir):
    """Scaled out-of-bag importance of the four custom forests, as ordered bars."""
    from functools import reduce
    parts = []
    for name, (forest, df) in bagged_forests(spark, sf_dir, CUSTOM_FORESTS).items():
        signed = md.importance_signed(md.oob_importance(forest, df))
        parts.append(tmx.ordered_bars(signed, "value", "X1").withColumn("model", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@register("rf_tuned")
def q_rf_tuned(spark, sf_dir, num_trees: int = 50):
    """Cross-validated accuracy of three features-per-split counts."""
    df = model_table(spark, sf_dir)
    return md.tune_forest(df, md.feature_columns(df, FULL_EXCLUDE), num_trees, seed=SEED)


FLAG_NAMES = [f.name for f in FIXTURE_FLAG_SPECS]


@register("unpivot_flags", o.with_articles(o.cleaned_cte(), o.rules_ctes(**RULE_KW),
                                           o.features_cte(flags=FIXTURE_FLAG_SPECS))
          + f" SELECT UniqueID, flag, CAST(value AS INTEGER) AS value FROM (SELECT UniqueID, "
          + ", ".join(FLAG_NAMES) + " FROM feat) UNPIVOT (value FOR flag IN (" + ", ".join(FLAG_NAMES) + "))")
def q_unpivot_flags(spark, sf_dir):
    df = ft.add_flags(filled(spark, sf_dir), FIXTURE_FLAG_SPECS).select("UniqueID", *FLAG_NAMES)
    return df.unpivot("UniqueID", FLAG_NAMES, "flag", "value")


@register("stratified_partition", o.with_articles(
    "r AS (SELECT UniqueID, Popular, row_number() OVER (PARTITION BY Popular ORDER BY UniqueID) AS rn,"
    " count(*) OVER (PARTITION BY Popular) AS n FROM articles WHERE Popular IS NOT NULL)")
    + " SELECT UniqueID, Popular, CAST(rn <= ceil(n * 0.5) AS INTEGER) AS in_first FROM r")
def q_stratified(spark, sf_dir):
    return md.stratified_partition(articles(spark, sf_dir), 0.5, seed=None)


@register("importance_signed", """
SELECT lang AS X1, 'MeanDecreaseAccuracy' AS X2, round(avg(n_chars) - 2000, 6) AS value,
       CASE WHEN round(avg(n_chars) - 2000, 6) >= 0 THEN 'positive' ELSE 'negative' END AS sign
FROM documents GROUP BY lang""")
def q_importance_signed(spark, sf_dir):
    """The sign column of an importance table; a stand-in for the importances
    (mean text length less 2000, by language) has values of both signs."""
    d = tables.documents(spark, sf_dir, ["lang", "n_chars"], spread_rows=False)
    imp = d.groupBy(F.col("lang").alias("feature")).agg((F.avg("n_chars") - 2000).alias("importance"))
    return md.importance_signed(imp.select("feature", r6("importance")))


@register("stem_vocabulary")
def q_stem_vocabulary(spark, sf_dir):
    """Vocabulary job: every distinct cleaned token of the documents and its stem."""
    from newsfeat.functions.stem import stem_vocabulary
    d = tables.documents(spark, sf_dir)
    return stem_vocabulary(tmx.clean_tokens(F.col("text"), STOP), d)


TERM_PATTERNS = {f.name: (f.pattern(), f.ignore_case) for f in FIXTURE_FLAG_SPECS}


def _term_popularity_sql() -> str:
    parts = []
    for name, (pat, ic) in TERM_PATTERNS.items():
        h, t = o.s_matches("Headline", pat, ic), o.s_matches("Text", pat, ic)
        parts.append(f"""SELECT {o.q(name)} AS pattern,
  round(avg(CASE WHEN Popular IS NOT NULL AND {h} THEN CAST(Popular AS DOUBLE) END), 6) AS avgPopHeadTrain,
  count(*) FILTER (WHERE Popular IS NOT NULL AND {h}) AS numArtHeadTrain,
  round(avg(CASE WHEN Popular IS NOT NULL AND {t} THEN CAST(Popular AS DOUBLE) END), 6) AS avgPopTextTrain,
  count(*) FILTER (WHERE Popular IS NOT NULL AND {t}) AS numArtTextTrain,
  count(*) FILTER (WHERE Popular IS NULL AND {h}) AS numArtHeadTest,
  count(*) FILTER (WHERE Popular IS NULL AND {t}) AS numArtTextTest
FROM filled""")
    return o.with_articles(o.cleaned_cte(), o.rules_ctes(**RULE_KW)) + " " + " UNION ALL ".join(parts)


@register("term_popularity", _term_popularity_sql())
def q_term_popularity(spark, sf_dir):
    tp_ = ft.term_popularity(filled(spark, sf_dir), TERM_PATTERNS)
    return tp_.select("pattern", r6("avgPopHeadTrain"), "numArtHeadTrain", r6("avgPopTextTrain"),
                      "numArtTextTrain", "numArtHeadTest", "numArtTextTest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.run for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}
