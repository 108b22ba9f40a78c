"""SQL twins of the Spark operators, for the DuckDB oracle check.

Each ``s_*`` helper returns a DuckDB SQL expression equal to the Spark column
expression of the same name; the pattern strings are shared with the Spark
side (``newsfeat.functions``) so both engines run the very same regexes.
``articles_ctes`` and friends build the CTE chain that mirrors
``newsfeat.plans.pipeline``.  Nothing here runs on Spark.
"""

from __future__ import annotations

from newsfeat.functions import fixed
from newsfeat.functions import text as tx
from newsfeat.functions.calendar import holiday_year_days
from newsfeat.functions.patterns import FlagSpec, build_pattern, default_flags
from newsfeat.sources import fixtures as fx


def q(s: str) -> str:
    """SQL string literal (DuckDB strings keep backslashes verbatim)."""
    return "'" + str(s).replace("'", "''") + "'"


def _case_mod(expr: str, mapping: dict[int, str], default: str = "") -> str:
    whens = " ".join(f"WHEN {k} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {q(default)} END"


_BODY = f"regexp_replace(d.text, {q(fx.BODY_PATTERN)}, '')"
_PARAGRAPH = f"split_part({_BODY}, chr(10), 1)"

ARTICLES_SQL = f"""
SELECT d.doc_id AS UniqueID,
       {_case_mod('d.doc_id % 7', fx.DESK_BY_MOD7)} AS NewsDesk,
       {_case_mod('d.doc_id % 11', fx.SECTION_BY_MOD11)} AS SectionName,
       CASE WHEN d.doc_id % 3 = 0 THEN {q(fx.SUBSECTION_MOD3_ZERO)} ELSE '' END AS SubsectionName,
       '<b>' || replace(split_part(d.text, chr(10), 1), 'é', '&eacute;') || '</b>&hellip; ' AS Headline,
       CASE WHEN d.doc_id % 10 IN ({', '.join(map(str, fx.SNIPPET_IS_PARAGRAPH))}) THEN {_PARAGRAPH} ELSE {_BODY} END AS Snippet,
       CASE WHEN d.doc_id % 10 IN ({', '.join(map(str, fx.ABSTRACT_IS_PARAGRAPH))}) THEN {_PARAGRAPH} ELSE {_BODY} END AS Abstract,
       CAST(length(d.text) - length(replace(d.text, ' ', '')) + 1 AS INTEGER) AS WordCount,
       make_timestamp(({fx.PUBDATE_EPOCH_START} + (d.doc_id * {fx.PUBDATE_MULTIPLIER}) % {fx.PUBDATE_SPAN_SECONDS}) * 1000000) AS PubDate,
       CAST(l.quality AS INTEGER) AS Popular
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


# ------------------------------------------------------------------ text
def s_strip_tags(x: str) -> str:
    return f"regexp_replace({x}, {q(tx.TAG_PATTERN)}, '', 'gs')"


def s_drop_entities(x: str, strict: bool = True) -> str:
    return f"regexp_replace({x}, {q(tx.drop_entities_pattern(strict))}, '', 'g')"


def s_fold_diacritics(x: str) -> str:
    return f"regexp_replace({x}, {q(tx.DIACRITIC_PATTERN)}, '\\1', 'g')"


def s_trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(tx.TRIM_PATTERN)}, '', 'g')"


def s_cleanup(x: str, strict: bool = True) -> str:
    return s_trim_ws(s_fold_diacritics(s_drop_entities(s_strip_tags(x), strict)))


def s_mgsub(x: str, pairs, ignore_case: bool = True) -> str:
    opts = "'gi'" if ignore_case else "'g'"
    for p, r in pairs:
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, {opts})"
    return x


def s_longer_of(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) > length({b}) THEN {a} ELSE {b} END"


def s_word_count(x: str) -> str:
    cleaned = f"regexp_replace({x}, {q(tx.PUNCT_PATTERN)}, '', 'g')"
    return (f"CAST(greatest(len(regexp_extract_all({cleaned}, {q(tx.WORD_SEPARATOR_PATTERN)})), 1) + 1"
            f" AS INTEGER)")


def s_matches(x: str, pattern: str, ignore_case: bool = False) -> str:
    from newsfeat.functions.patterns import lower_pattern
    call = (f"regexp_matches(lower({x}), {q(lower_pattern(pattern))})" if ignore_case
            else f"regexp_matches({x}, {q(pattern)})")
    return f"coalesce({call}, false)"


def s_flag(spec: FlagSpec, field_expr: str | None = None) -> str:
    return f"CAST({s_matches(field_expr or spec.field, spec.pattern(), spec.ignore_case)} AS INTEGER)"


# -------------------------------------------------------------- calendar
def s_yday0(ts: str) -> str:
    return f"(dayofyear({ts}) - 1)"


def s_holiday(ts: str, dates=fixed.HOLIDAYS) -> str:
    days = ", ".join(str(d) for d in holiday_year_days(dates))
    return f"CAST(coalesce({s_yday0(ts)} IN ({days}), false) AS INTEGER)"


def s_before_holiday(ts: str, dates=fixed.HOLIDAYS, from_hour=fixed.BEFORE_HOLIDAY_FROM_HOUR) -> str:
    days = ", ".join(str(d - 1) for d in holiday_year_days(dates))
    return f"CAST(coalesce({s_yday0(ts)} IN ({days}) AND hour({ts}) >= {from_hour}, false) AS INTEGER)"


# --------------------------------------------------------------- CTE chain
def cleaned_cte(src: str = "articles", phrases=fixed.PHRASES, strict: bool = True) -> str:
    """CTEs ``c0``..``cleaned`` after ``src``."""
    return f"""
c0 AS (SELECT * REPLACE ({s_cleanup('Headline', strict)} AS Headline),
              {s_cleanup('Snippet', strict)} AS __snip, {s_cleanup('Abstract', strict)} AS __abs
       FROM {src}),
c1 AS (SELECT * EXCLUDE (__snip, __abs), {s_longer_of('__snip', '__abs')} AS Summary FROM c0),
c2 AS (SELECT * REPLACE ({s_mgsub('Headline', phrases)} AS Headline, {s_mgsub('Summary', phrases)} AS Summary)
       FROM c1),
cleaned AS (SELECT *, concat_ws(' ', Headline, Summary) AS Text FROM c2)"""


def _lookup_case(target: str, key: str, table) -> str:
    whens = " ".join(f"WHEN {target} = '' AND {key} = {q(k)} THEN {q(v)}" for k, v in table)
    return f"CASE {whens} ELSE {target} END"


def _masked(cond: str, values) -> str:
    cols = ("NewsDesk", "SectionName", "SubsectionName")
    parts = ", ".join(f"CASE WHEN coalesce({cond}, false) THEN {q(v)} ELSE {c} END AS {c}" for c, v in zip(cols, values))
    return f"SELECT * REPLACE ({parts})"


def _rule_cond(rule) -> str:
    desk, section, _ = rule
    cond = f"SectionName = {q(section)}"
    return cond if desk is None else f"NewsDesk = {q(desk)} AND {cond}"


def rules_ctes(src: str = "cleaned", headline_prefixes=fixed.POLITICS_HEADLINE_PREFIXES,
               text_terms=fixed.POLITICS_TEXT_TERMS, text_acronyms=fixed.POLITICS_TEXT_ACRONYMS,
               upto: str = "filled") -> str:
    """CTEs ``r1`` (desk fill) .. ``filled`` (blanks -> Missing)."""
    pol = fixed.POLITICS_CATEGORIES
    all_blank = "NewsDesk = '' AND SectionName = '' AND SubsectionName = ''"
    steps = [
        ("r1", f"SELECT * REPLACE ({_lookup_case('NewsDesk', 'SectionName', fixed.DESK_FROM_SECTION)} AS NewsDesk)"),
        ("r2", _masked(_rule_cond(fixed.PUZZLES_RULE), fixed.PUZZLES_RULE[2])),
        ("r3", _masked(_rule_cond(fixed.STYLE_RULE), fixed.STYLE_RULE[2])),
        ("r4", f"SELECT * REPLACE ({_lookup_case('SectionName', 'NewsDesk', fixed.SECTION_FROM_DESK)} AS SectionName)"),
        ("r5", _masked(f"{all_blank} AND {s_matches('Headline', build_pattern(headline_prefixes, 'prefix'), True)}", pol)
         if headline_prefixes else "SELECT *"),
        ("r6", _masked(f"SectionName = '' AND {s_matches('Text', build_pattern(text_terms), True)}", pol)
         if text_terms else "SELECT *"),
        ("r7", _masked(f"SectionName = '' AND {s_matches('Text', build_pattern(text_acronyms), False)}", pol)
         if text_acronyms else "SELECT *"),
        ("filled", "SELECT * REPLACE (" + ", ".join(
            f"CASE WHEN {c} = '' THEN {q(fixed.MISSING_LABEL)} ELSE {c} END AS {c}"
            for c in ("NewsDesk", "SectionName", "SubsectionName")) + ")"),
    ]
    out, prev = [], src
    for name, body in steps:
        out.append(f"{name} AS ({body} FROM {prev})")
        prev = name
        if name == upto:
            break
    return ",\n".join(out)


def features_cte(src: str = "filled", flags: list[FlagSpec] | None = None, name: str = "feat") -> str:
    flags = default_flags() if flags is None else flags
    flag_sql = ",\n       ".join(f"{s_flag(f)} AS {f.name}" for f in flags)
    return f"""{name} AS (
SELECT *,
       CAST(PubDate AS DATE) AS PubDay,
       CAST(dayofweek(PubDate) AS INTEGER) AS Weekday,
       CAST(hour(PubDate) AS INTEGER) AS Hour,
       ln(1 + CAST(WordCount AS DOUBLE)) AS LogWC,
       CAST(length(Headline) AS INTEGER) AS HeadlineCharCount,
       CAST(length(Summary) AS INTEGER) AS SummaryCharCount,
       {s_word_count('Headline')} AS HeadlineWordCount,
       {s_word_count('Summary')} AS SummaryWordCount,
       coalesce(CAST(Popular AS VARCHAR), {q(fixed.UNLABELLED_DISPLAY)}) AS Pop,
       CAST(coalesce(length(Headline) <= {fixed.SEO_MAX_CHARS}, false) AS INTEGER) AS SEO,
       {flag_sql},
       {s_holiday('PubDate')} AS Holiday,
       {s_before_holiday('PubDate')} AS BeforeHoliday,
       dayname(PubDate) AS DayOfWeek,
       CAST((dayofweek(PubDate) + 6) % 7 AS INTEGER) AS DayOfWeekOrder
FROM {src})"""


def counts_ctes(src: str = "feat", name: str = "featc") -> str:
    return f"""
daily AS (SELECT PubDay, count(*) AS NumDailyArticles FROM {src} WHERE PubDay IS NOT NULL GROUP BY PubDay),
daysec AS (SELECT PubDay, SectionName, count(*) AS NumDailySectionArticles FROM {src}
           WHERE PubDay IS NOT NULL AND SectionName IS NOT NULL GROUP BY PubDay, SectionName),
dayhour AS (SELECT PubDay, Hour, count(*) AS NumHourlyArticles FROM {src}
            WHERE PubDay IS NOT NULL AND Hour IS NOT NULL GROUP BY PubDay, Hour),
{name} AS (SELECT f.*, d.NumDailyArticles, s.NumDailySectionArticles, h.NumHourlyArticles
         FROM {src} f
         LEFT JOIN daily d ON f.PubDay = d.PubDay
         LEFT JOIN daysec s ON f.PubDay = s.PubDay AND f.SectionName = s.SectionName
         LEFT JOIN dayhour h ON f.PubDay = h.PubDay AND f.Hour = h.Hour)"""


def with_articles(*ctes: str) -> str:
    return "WITH articles AS (" + ARTICLES_SQL + "),\n" + ",\n".join(c.strip().rstrip(",") for c in ctes)


def feature_chain(flags=None, phrases=fixed.PHRASES, counts: bool = True, **rule_kwargs) -> str:
    parts = [cleaned_cte(phrases=phrases), rules_ctes(**rule_kwargs), features_cte(flags=flags)]
    if counts:
        parts.append(counts_ctes())
    return with_articles(*parts)


# -------------------------------------------------------------- text mining
def s_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def s_clean_tokens(x: str, stopwords=None) -> str:
    lowered = f"regexp_replace(lower({x}), {q(tx.PUNCT_PATTERN)}, '', 'g')"
    toks = f"string_split_regex({lowered}, {q(tx.WHITESPACE + '+')})"
    if stopwords:
        return f"list_filter({toks}, lambda t: t <> '' AND NOT list_contains({s_list(stopwords)}, t))"
    return f"list_filter({toks}, lambda t: t <> '')"


def s_ngrams(toks: str, n_min: int = 1, n_max: int = 1) -> str:
    parts = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            parts.append(toks)
        else:
            parts.append(f"list_transform(range(1, len({toks}) - {n} + 2), "
                         f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' '))")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def s_long_terms(terms: str, min_chars: int = 3) -> str:
    return f"list_filter({terms}, lambda t: length(t) >= {min_chars})"


def corpus_ctes(src_sql: str, id_col: str, text_col: str, stopwords=None, n_min: int = 1, n_max: int = 1,
                prefix: str = "") -> str:
    """CTEs ``{prefix}toks``, ``{prefix}corp`` (doc_id, terms), ``{prefix}tc``
    (doc_id, term, tf, doc_total), ``{prefix}ndocs`` (n)."""
    p = prefix
    return f"""
{p}toks AS (SELECT {id_col} AS doc_id, {s_clean_tokens(text_col, stopwords)} AS tokens FROM ({src_sql}) src),
{p}corp AS (SELECT doc_id, {s_long_terms(s_ngrams('tokens', n_min, n_max))} AS terms FROM {p}toks),
{p}tc AS (SELECT doc_id, term, count(*) AS tf, max(doc_total) AS doc_total
         FROM (SELECT doc_id, len(terms) AS doc_total, unnest(terms) AS term FROM {p}corp) GROUP BY doc_id, term),
{p}ndocs AS (SELECT count(*) AS n FROM {p}corp),
{p}dfreq AS (SELECT term, count(*) AS df FROM {p}tc GROUP BY term)"""


def s_keep_dense(df_expr: str, n_expr: str, sparse: float) -> str:
    keep = repr(1.0 - sparse)
    return f"CAST({df_expr} AS DOUBLE) > CAST({n_expr} AS DOUBLE) * CAST({keep} AS DOUBLE)"


def s_sanitize_names(prefix: str, term: str) -> str:
    return f"regexp_replace({q(prefix)} || {term}, {q(r'[^\p{L}\p{N}._]')}, '.', 'g')"
