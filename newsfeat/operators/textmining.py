"""Corpus cleaning, term matrices, sparsity cut, n-grams and TF-IDF - all in
long form ``(doc_id, term, value)``, never as a dense matrix.

Plan notes
----------
* Cleaning and n-gram generation are per-row array expressions; the per-
  document term total (the TF-IDF length basis) is the size of the filtered
  term array, so it needs neither a window nor a join.
* ``term_counts`` counts within each row; rows are shuffled only where an id
  has several.
* Document frequency is ``groupBy(term)`` over distinct pairs - partial
  aggregation makes a term present in a third of all documents cost one row
  per task.  The sparsity cut filters the frequency table **before** it is
  joined back; the join's size decision (broadcast or sort-merge with skew
  split) is AQE's, from measured sizes.
* The corpus size ``N`` is a scalar metric read once with ``count()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsfeat.functions.text import PUNCT_PATTERN, WHITESPACE

MIN_TERM_CHARS = 3


def clean_tokens(text: Column, stopwords: list[str] | None = None) -> Column:
    """Lower case -> punctuation removed -> whitespace tokens -> stop words dropped.

    Stop words are matched as whole tokens after punctuation removal, so
    ``don't`` becomes ``dont`` and is no longer a stop word (the script's
    order, kept).  Tokens of every length are kept here; the term matrices
    drop short terms.
    """
    lowered = F.regexp_replace(F.lower(text), PUNCT_PATTERN, "")
    toks = F.split(lowered, f"{WHITESPACE}+")
    stop = list(stopwords or [])
    if stop:
        return F.filter(toks, lambda t: (t != "") & ~t.isin(stop))
    return F.filter(toks, lambda t: t != "")


def ngrams(tokens: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """All word n-grams with ``n_min <= n <= n_max``, joined by one space.

    Built with ``zip_with`` of shifted slices: lambdas only see their own
    arguments, so the token array is computed once per row (a lambda that
    referenced the token expression itself would re-evaluate the whole
    cleaning chain for every position)."""
    grams, current = {1: tokens}, tokens
    for n in range(2, n_max + 1):
        shifted = F.slice(tokens, n, F.greatest(F.size(tokens), F.lit(1)))
        current = F.zip_with(current, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        grams[n] = current
    parts = [grams[n] if n == 1 else F.filter(grams[n], lambda g: g.isNotNull())
             for n in range(n_min, n_max + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def long_terms(terms: Column, min_chars: int = MIN_TERM_CHARS) -> Column:
    return F.filter(terms, lambda t: F.length(t) >= min_chars)


def corpus_tokens(df: DataFrame, id_col: str, text_col: str, stopwords=None, stemmer=None) -> DataFrame:
    """``(doc_id, tokens)``, a row per row of ``df`` (empty documents kept: they
    count in ``N``)."""
    out = df.select(F.col(id_col).alias("doc_id"), clean_tokens(F.col(text_col), stopwords).alias("tokens"))
    return stemmer(out, "tokens") if stemmer is not None else out


def corpus(df: DataFrame, id_col: str, text_col: str, stopwords=None, n_min: int = 1, n_max: int = 1,
           stemmer=None) -> DataFrame:
    """``(doc_id, terms)`` - terms of the matrix for every document.  Stemmed
    tokens are written once: a corpus is read for its vocabulary and again for its
    terms."""
    from newsfeat.session import written_table
    out = corpus_tokens(df, id_col, text_col, stopwords, stemmer)
    if stemmer is not None:
        out = written_table(out, "stems")
    return terms_of(out, n_min, n_max)


def terms_of(toks: DataFrame, n_min: int = 1, n_max: int = 1) -> DataFrame:
    """``(doc_id, terms)`` from ``(doc_id, tokens)``."""
    return toks.select("doc_id", long_terms(ngrams(F.col("tokens"), n_min, n_max)).alias("terms"))


def explode_terms(arr) -> Column:
    """``explode_outer`` + a null filter instead of ``explode``: for ``explode``
    the optimizer infers ``size(arr) > 0`` and pushes it below the projection
    that builds ``arr``, evaluating the whole tokenizer a second time."""
    return F.explode_outer(arr)


def _row_counts(corp: DataFrame) -> DataFrame:
    """``(doc_id, term, tf, doc_total)`` row by row: the sorted terms of a row are cut
    where they change, so nothing is shuffled."""
    rows = corp.select("doc_id", F.size("terms").alias("doc_total"), F.sort_array("terms").alias("terms"))
    here = F.when(F.size("terms") > 0, F.sequence(F.lit(0), F.size("terms") - 1))
    rows = rows.select("*", F.filter(here, lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1))).alias("starts"))
    counted = F.transform("starts", lambda at, i: F.struct(
        F.get("terms", at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size("terms")) - at).cast("long").alias("tf")))
    return (rows.select("doc_id", "doc_total", explode_terms(counted).alias("e")).where(F.col("e").isNotNull())
                .select("doc_id", "e.term", "e.tf", "doc_total"))


def term_counts(corp: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Document-term matrix in long form: ``(doc_id, term, tf, doc_total)``.

    Terms are counted within their row; only where an id has several rows are the
    counts added up by a shuffle.  With a ``vocabulary(term, df)`` only its terms are
    kept, with their ``df``; they are picked before the rows are grouped, so a
    broadcast vocabulary leaves nothing else to shuffle."""
    if vocabulary is None:
        rows = _row_counts(corp)
        if corp.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return rows
        return rows.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.max("doc_total").alias("doc_total"))
    rows = (corp.select("doc_id", F.size("terms").alias("doc_total"), explode_terms("terms").alias("term"))
                .where(F.col("term").isNotNull()).join(vocabulary, "term"))
    return rows.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("doc_total").alias("doc_total"),
                                              F.max("df").alias("df"))


def document_frequency(tc: DataFrame) -> DataFrame:
    return tc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def sparse_threshold(n_docs: int, sparse: float) -> float:
    """Kept terms have ``df > n_docs * (1 - sparse)``, computed in doubles as the
    script does (so ``1 - 0.99`` keeps its binary rounding)."""
    return float(n_docs) * (1.0 - sparse)


def keep_dense_terms(dfreq: DataFrame, n_docs: int, sparse: float) -> DataFrame:
    """Sparsity cut (strict ``>``)."""
    return dfreq.where(F.col("df").cast("double") > F.lit(sparse_threshold(n_docs, sparse)))


# Largest vocabulary broadcast to every task (terms); above it the join is a
# shuffled one.
MAX_BROADCAST_TERMS = 1_000_000


def corpus_frequency(corp: DataFrame) -> DataFrame:
    """``(term, df)`` from each document's distinct terms: only partial counts
    are shuffled."""
    return (corp.select(explode_terms(F.array_distinct("terms")).alias("term")).where(F.col("term").isNotNull())
                .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def dense_vocabulary(corp: DataFrame, n_docs: int, sparse: float) -> DataFrame:
    """``(term, df)`` of the terms that survive the sparsity cut, written once;
    its size is counted before it is broadcast."""
    from newsfeat.session import written_table
    kept = written_table(keep_dense_terms(corpus_frequency(corp), n_docs, sparse), "vocabulary")
    return F.broadcast(kept) if kept.count() <= MAX_BROADCAST_TERMS else kept


def remove_sparse_terms(toks: DataFrame, n_docs: int, sparse: float, n_min: int = 1, n_max: int = 1) -> DataFrame:
    """Term-count rows of the ``n_min`` to ``n_max``-grams of ``toks(doc_id,
    tokens)`` that survive the sparsity cut, with their document frequency; n-grams
    with a part below the cut are never formed (``grams``).  ``toks`` is read twice:
    give a written table.  A vocabulary too large to be broadcast is joined."""
    from newsfeat.operators import grams
    from newsfeat.session import written_table
    tokens = toks.select("doc_id", F.col("tokens").alias("terms"))
    kept = written_table(keep_dense_terms(corpus_frequency(tokens), n_docs, sparse), "vocabulary")
    found = None
    if kept.count() <= MAX_BROADCAST_TERMS:
        vocabulary = sorted((r.term, r.df) for r in kept.collect())
        found = grams.dense_counts(toks, vocabulary, sparse_threshold(n_docs, sparse), n_min, n_max, MIN_TERM_CHARS, MAX_BROADCAST_TERMS)
    if found is None:
        corp = terms_of(toks, n_min, n_max)
        found = term_counts(corp, dense_vocabulary(corp, n_docs, sparse))
    return found


def _weighted(tc: DataFrame, n_docs: int) -> DataFrame:
    return tc.select("doc_id", "term", "tf", "df",
                     (F.col("tf") / F.col("doc_total") * F.log2(F.lit(float(n_docs)) / F.col("df"))).alias("weight"))


def tfidf(tc: DataFrame, n_docs: int) -> DataFrame:
    """``tf / document total * log2(N / df)`` of all terms."""
    return _weighted(tc.join(document_frequency(tc), "term"), n_docs)


def dense_tfidf(toks: DataFrame, n_docs: int, sparse: float, n_min: int = 1, n_max: int = 1) -> DataFrame:
    """``tfidf`` of the n-grams of ``toks`` after the sparsity cut (weights do not
    depend on the cut)."""
    return _weighted(remove_sparse_terms(toks, n_docs, sparse, n_min, n_max), n_docs)


def term_totals(tc: DataFrame, value: str = "tf", name: str = "freq") -> DataFrame:
    """Column sums of the term matrix (``colSums`` / ``rowSums``)."""
    return tc.groupBy("term").agg(F.sum(value).alias(name))


def frequent_terms(tc: DataFrame, low: float, value: str = "tf") -> DataFrame:
    """Terms whose total is at least ``low``."""
    return term_totals(tc, value).where(F.col("freq") >= low)


def global_rank(df: DataFrame, order: list[str], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based position of every row in the total order ``order`` (ascending,
    make it unique for a deterministic rank) without a single-partition window.

    ``repartitionByRange`` cuts the rows into ordered, balanced ranges (its
    sampled bounds split even a hot value once the order is unique); each range
    is numbered locally and shifted by the sizes of the ranges before it, read
    from a table with one row per range.  The ranged rows are written once with
    their range number: sizes and rows come from the same ranges, whatever
    columns each of them reads."""
    from newsfeat.session import written_table
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    ranged = written_table(df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__sz"))
    offsets = sizes.select("__pid", F.coalesce(F.sum("__sz").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    local = Window.partitionBy("__pid").orderBy(*order)
    return (ranged.withColumn("__r", F.row_number().over(local))
                  .join(F.broadcast(offsets), "__pid")
                  .select(*df.columns, (F.col("__off") + F.col("__r")).cast("long").alias(name)))


def ordered_bars(freq: DataFrame, value: str = "freq", label: str = "term") -> DataFrame:
    """Bar order of a frequency table: ascending value, ties by label."""
    return global_rank(freq, [value, label], "bar_order")


def top_k_per_group(df: DataFrame, group_col: str, k: int, value: str, label: str = "term",
                    buckets: int = 64) -> DataFrame:
    """Top ``k`` rows per group by ``value`` descending, ties by ``label``
    ascending, with a ``rank`` column.

    Two stages, exact: the top ``k`` inside each (group, hash bucket of the
    label), then the top ``k`` among those at most ``buckets * k`` survivors per
    group.  No window ever holds a whole group, so a group with a third of all
    rows is spread over ``buckets`` tasks."""
    order = [F.desc(value), F.asc(label)]
    b = F.pmod(F.xxhash64(F.col(label)), F.lit(buckets))
    stage1 = (df.withColumn("__b", b)
                .withColumn("__r", F.row_number().over(Window.partitionBy(group_col, "__b").orderBy(*order)))
                .where(F.col("__r") <= k).drop("__b", "__r"))
    return (stage1.withColumn("rank", F.row_number().over(Window.partitionBy(group_col).orderBy(*order)))
                  .where(F.col("rank") <= k))


def top_terms_per_group(tc: DataFrame, group_col: str, k: int, value: str = "freq") -> DataFrame:
    """Top ``k`` terms per group by value (ties: term ascending)."""
    return top_k_per_group(tc, group_col, k, value, "term")


def concat_ranked(top: DataFrame, group_col: str, sep: str = ", ") -> DataFrame:
    """One string per group: terms in rank order joined by ``sep``."""
    agg = top.groupBy(group_col).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("__t"))
    return agg.select(group_col, F.array_join(F.transform("__t", lambda s: s["term"]), sep).alias("terms"))


def sanitize_names(prefix: str, term: Column) -> Column:
    """``make.names(prefix + term)``: characters other than letters, digits,
    ``.`` and ``_`` become ``.``."""
    return F.regexp_replace(F.concat(F.lit(prefix), term), r"[^\p{L}\p{N}._]", ".")


def bag_of_words(headline_tc: DataFrame, summary_tc: DataFrame) -> DataFrame:
    """Long-form bag-of-words features ``(doc_id, feature, value)`` with the
    ``H`` / ``S`` name prefixes of the two corpora."""
    h = headline_tc.select("doc_id", sanitize_names("H", F.col("term")).alias("feature"), F.col("tf").alias("value"))
    s = summary_tc.select("doc_id", sanitize_names("S", F.col("term")).alias("feature"), F.col("tf").alias("value"))
    return h.unionByName(s)


def bind_columns(bow: DataFrame, frame: DataFrame, columns: list[str], id_col: str,
                 categories: set[str] = frozenset()) -> DataFrame:
    """The bag of words bound to metadata columns, in typed long form ``(doc_id,
    feature, number, level)``: terms and numeric columns have a number, text
    columns and ``categories`` a level.  A null stays as a row without either.
    Rows meet by their id, so nothing is joined or shuffled."""
    def entry(c: str) -> Column:
        text = c in categories or frame.schema[c].dataType.simpleString() == "string"
        return F.struct(F.lit(c).alias("feature"),
                        (F.lit(None) if text else F.col(c)).cast("double").alias("number"),
                        (F.col(c) if text else F.lit(None)).cast("string").alias("level"))

    meta = frame.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*[entry(c) for c in columns])).alias("e"))
    terms = bow.select("doc_id", "feature", F.col("value").cast("double").alias("number"), F.lit(None).cast("string").alias("level"))
    return terms.unionByName(meta.select("doc_id", "e.*"))


def n_docs(df: DataFrame) -> int:
    """Corpus size (a scalar metric)."""
    return df.count()
