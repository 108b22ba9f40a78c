"""Language identification with spans of mixed text.

Words are runs of letters and marks, found by table look-ups over code points.
A word's script narrows the languages it can belong to; hashed character
n-grams give it a log-probability for each of them; Viterbi decoding with a
penalty for switching labels every word, and neighbouring words of one label
make a span.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsfeat.llm.common import crc_mod, read, utf8
from newsfeat.session import written_table

SAMPLE = 3_000            # training documents of each language, at most
FOLDS, HELD_OUT = 4, 2    # rows whose id has crc32 % FOLDS == HELD_OUT are held out
BUCKETS = 1 << 16         # of hashed n-grams
ORDERS = (1, 2, 3, 4)     # n-gram lengths, the word's edges included
WORD_SAY = 12.0           # the most that one word can speak for or against a language (nats)
SWITCH = 8.0              # penalty of changing the language between two words (nats)
LONGEST = 32              # longer runs of letters (scripts without spaces) are cut up
CHARS_AT_ONCE = 500_000   # code points whose n-grams are held together
CELLS_AT_ONCE = 8_000_000  # word x language scores that are held together
UNKNOWN = "und"

# First code points of script ranges; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x2DE0, "cyrillic"), (0x2E00, "other"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
    (0x32000, "other"),
]


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Per code point: 0 no word character, 1 mark, 2 letter; its lower case
    (where that is one code point); the number of its script; script names."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] in "LM":
            kind[c] = 2 if category[0] == "L" else 1
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    names = sorted({name for _, name in SCRIPTS})
    script = np.zeros(0x110000, np.uint8)
    for (start, name), end in zip(SCRIPTS, [s for s, _ in SCRIPTS[1:]] + [0x110000]):
        script[start:end] = names.index(name)
    return kind, lower, script, names


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one offsets of the words that hold a letter."""
    kind = tables()[0][codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], kind > 0, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    pieces = -(-(ends - starts) // LONGEST)
    if len(pieces) and pieces.max() > 1:
        run = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = starts[run] + nth * LONGEST, np.minimum(ends[run], starts[run] + (nth + 1) * LONGEST)
    letters = np.concatenate(([0], np.cumsum(kind == 2)))
    held = letters[ends] > letters[starts]
    return starts[held], ends[held]


def grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, bucket) of the hashed n-grams of each length."""
    sizes = ends - starts + 2
    word = np.repeat(np.arange(len(starts)), sizes)
    first = np.cumsum(sizes) - sizes
    at = np.arange(len(word)) - first[word] + starts[word] - 1
    inside = (at >= starts[word]) & (at < ends[word])
    flat = np.where(inside, tables()[1][codes[np.clip(at, 0, max(len(codes) - 1, 0))]], np.uint32(1)).astype(np.uint64)
    hashed = np.zeros(len(flat), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        hashed = hashed[:len(flat) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + flat[n - 1:] + np.uint64(n)
        if n in ORDERS and len(hashed):
            whole = word[:len(hashed)] == word[n - 1:]
            mixed = hashed[whole]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield word[:len(whole)][whole], (mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")


def _word_groups(starts: np.ndarray, ends: np.ndarray) -> Iterator[slice]:
    """Slices of words of about CHARS_AT_ONCE code points together."""
    upto = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHARS_AT_ONCE, "right")))
        yield slice(at, stop)
        at = stop


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray      # BUCKETS x languages, log-probabilities
    allowed: np.ndarray    # scripts x languages, whether the language uses the script

    def scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """words x languages; languages that don't use a word's script are out,
        unless no learned language does (then the word says nothing)."""
        out = np.zeros((len(starts), len(self.languages)), np.float32)
        for part in _word_groups(starts, ends):
            a, b = starts[part], ends[part]
            total = np.zeros((len(a), len(self.languages)), np.float64)
            for word, bucket in grams(codes, a, b):
                for lang in range(total.shape[1]):
                    total[:, lang] += np.bincount(word, self.table[bucket, lang], len(a))
            total -= total.max(1, keepdims=True)
            out[part] = np.maximum(total, -WORD_SAY)
        kind, _, script, _ = tables()
        letter = np.where(kind[codes[starts]] == 2, codes[starts], codes[ends - 1]) if len(starts) else starts
        fits = self.allowed[script[letter]]
        known = fits.any(1, keepdims=True)
        out = np.where(known, np.where(fits, out, -WORD_SAY - 50), 0)
        return (out - out.max(1, keepdims=True, initial=-1e9)).astype(np.float32)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language number of each word; text d owns the words
    ``bounds[d]:bounds[d + 1]``.  All texts take each step together."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    n = int((sizes > 0).sum())
    labels = np.zeros(len(scores), np.int16)
    if not n:
        return labels
    switched, best_before = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    best = scores[starts[:n]].astype(np.float64)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # texts with more than t words
    for t in range(1, sizes[0]):
        k = active[t]
        at = starts[:k] + t
        now = best[:k]
        top = now.argmax(1)
        jump = now[np.arange(k), top][:, None] - penalty
        switched[at] = jump > now
        best_before[at] = top
        best[:k] = np.maximum(now, jump) + scores[at]
    label = best.argmax(1).astype(np.int16)
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = label[:k]
        if t:
            label[:k] = np.where(switched[at, label[:k]], best_before[at], label[:k])
    return labels


# ---------------------------------------------------------------------- fitting
def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """``(lang, t)`` of at most ``per_language`` documents of each language, by
    hash order of the id, outside the held-out fold.

    From the languages' counts follows a bound on the hash below which about
    twice as many lie; only these ids are ranked, so a language with most of the
    rows brings no more to a task than a small one.  The ids are broadcast."""
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(lang_col).alias("lang"), F.col(text_col).alias("__text"))
    ids = (rows.where((crc_mod("__doc", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("__doc").isNotNull())
           .select("lang", "__doc", F.pmod(F.xxhash64("__doc"), F.lit(1 << 40)).alias("h")))
    counts = ids.groupBy("lang").agg(F.least(F.lit(1.0), 2.0 * per_language / F.count("*")).alias("share"))
    first = Window.partitionBy("lang").orderBy("h", "__doc")
    ids = (ids.join(F.broadcast(counts), "lang").where(F.col("h") < F.col("share") * (1 << 40))
           .withColumn("n", F.row_number().over(first)).where(F.col("n") <= per_language)
           .select(F.col("__doc").alias("__id")).distinct())
    found = (rows.where("lang IS NOT NULL AND __text IS NOT NULL").join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
             .select("lang", utf8("__text").alias("t")))
    return written_table(found, "langid-sample")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = SAMPLE) -> Model:
    """Smoothed n-gram frequencies and script use of each language; counted by
    the executors, added up by Spark, at most BUCKETS x languages numbers in all."""
    sample = training_sample(docs, id_col, text_col, lang_col, per_language)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        script = tables()[2]
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["t"]:
                buckets, scripts = np.zeros(BUCKETS, np.int64), np.zeros(256, np.int64)
                for raw in texts:
                    codes = _codes(raw)
                    starts, ends = words_of(codes)
                    for part in _word_groups(starts, ends):
                        for _, bucket in grams(codes, starts[part], ends[part]):
                            buckets += np.bincount(bucket, minlength=BUCKETS)
                    scripts += np.bincount(script[codes[starts]], minlength=256)
                for kind, counts in (("gram", buckets), ("script", scripts)):
                    seen = np.flatnonzero(counts)
                    yield pd.DataFrame({"lang": lang, "kind": kind, "slot": seen, "n": counts[seen]})

    counts = (sample.mapInPandas(count, "lang string, kind string, slot int, n long")
              .groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(languages)), 0.5)
    allowed = np.zeros((256, len(languages)), bool)
    for i, lang in enumerate(languages):
        own = counts[counts["lang"] == lang]
        grams_, scripts = own[own["kind"] == "gram"], own[own["kind"] == "script"]
        table[grams_["slot"], i] += grams_["n"]
        used = scripts[scripts["n"] >= 0.02 * scripts["n"].sum()]
        allowed[used["slot"], i] = True
    return Model(languages, np.log(table / table.sum(0, keepdims=True)), allowed)


# ------------------------------------------------------------------- predicting
def _texts(raws: list[bytes], model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first offsets, last-plus-one offsets, language numbers) of each text's
    words, a bounded number of words at a time."""
    group: list[tuple] = []

    def decode() -> Iterator[tuple]:
        bounds = np.concatenate(([0], np.cumsum([len(g[0]) for g in group])))
        labels = viterbi(np.concatenate([g[2] for g in group]), bounds)
        for (starts, ends, _), a, b in zip(group, bounds, bounds[1:]):
            yield starts, ends, labels[a:b]

    held = 0
    for raw in raws:
        codes = _codes(raw)
        starts, ends = words_of(codes)
        group.append((starts, ends, model.scores(codes, starts, ends)))
        held += len(starts) * max(1, len(model.languages))
        if held > CELLS_AT_ONCE:
            yield from decode()
            group, held = [], 0
    if group:
        yield from decode()


def label_languages(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with a struct ``__lang``: ``lang``, ``score`` and, if asked for,
    ``spans`` (first, last, lang; offsets in code points).

    ``lang`` is the language of most letters and ``score`` its share of them.
    A null text, one without a letter, and any text when nothing was learned get
    ``und`` and 0.  Rows and other columns stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    kind = "lang string, score double" + (", spans array<struct<first:int,last:int,lang:string>>" if spans else "")

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = sent.value.languages
        for batch in batches:
            out: list[tuple] = []
            found = _texts(batch.tolist(), sent.value) if names else (((), (), ()) for _ in batch)
            for starts, ends, labels in found:
                if not len(starts):
                    out.append((UNKNOWN, 0.0, []))
                    continue
                weight = np.bincount(labels, ends - starts, len(names))
                top = int(weight.argmax())
                row = (names[top], float(weight[top] / weight.sum()), [])
                if spans:
                    cut = np.flatnonzero(np.diff(labels)) + 1
                    firsts, lasts = np.concatenate(([0], cut)), np.concatenate((cut, [len(labels)])) - 1
                    row = (*row[:2], [{"first": int(starts[a]), "last": int(ends[b]), "lang": names[labels[a]]}
                                      for a, b in zip(firsts, lasts)])
                out.append(row)
            yield pd.DataFrame(out, columns=["lang", "score", "spans"])[["lang", "score"] + ["spans"] * spans]

    return docs.withColumn("__lang", run(utf8(text_col)))


def q_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = label_languages(docs.select("doc_id", "text"), fit(docs), spans=True)
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
                        F.col("__lang.lang").alias("lang_pred"), F.col("__lang.score").alias("score"),
                        F.size("__lang.spans").alias("n_spans"))
