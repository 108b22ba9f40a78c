"""English stemming (the published Porter2 / Snowball English algorithm).

No stemmer ships with Spark, so this is Python, but not per token: a batch of
token arrays is dictionary-encoded by Arrow, each distinct token of the batch is
stemmed (memoised per worker process), and the stems are taken back by index.
A document's tokens never leave its row, so nothing is shuffled.
``stem_vocabulary`` is the vocabulary job: distinct tokens -> stems.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")

# Published exception lists of the algorithm.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli",
    "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_STEP1A_INVARIANT = frozenset(
    ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"])
R1_PREFIXES = ("gener", "commun", "arsen")

STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"),
         ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"),
         ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"),
         ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
         ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
         ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous",
         "ive", "ize", "ion", "al", "er", "ic"]


def _is_vowel(w: str, i: int) -> bool:
    return w[i] in VOWELS


def _region_after_vc(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if not _is_vowel(w, i) and _is_vowel(w, i - 1):
            return i + 1
    return len(w)


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in R1_PREFIXES if w.startswith(p)), None)
    if r1 is None:
        r1 = _region_after_vc(w, 0)
    r2 = _region_after_vc(w, r1) if r1 < len(w) else len(w)
    return r1, r2


def _short_syllable_end(w: str) -> bool:
    if len(w) >= 3:
        return (not _is_vowel(w, -3) and _is_vowel(w, -2) and not _is_vowel(w, -1)
                and w[-1] not in "wxY")
    return len(w) == 2 and _is_vowel(w, 0) and not _is_vowel(w, 1)


def _longest(w: str, suffixes) -> str | None:
    for s in sorted(suffixes, key=len, reverse=True):
        if w.endswith(s):
            return s
    return None


@lru_cache(maxsize=1 << 18)
def stem(word: str) -> str:
    if word is None or len(word) <= 2:
        return word
    w = word.lstrip("'")
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    if w.startswith("y"):
        w = "Y" + w[1:]
    w = w[0] + "".join("Y" if c == "y" and w[i] in VOWELS else c for i, c in enumerate(w[1:]))
    r1, r2 = _regions(w)

    # Step 0
    s = _longest(w, ("'s'", "'s", "'"))
    if s:
        w = w[: -len(s)]
    # Step 1a
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-3] + ("i" if len(w) > 4 else "ie")
    elif s == "s":
        if any(c in VOWELS for c in w[:-2]):
            w = w[:-1]
    if w in AFTER_STEP1A_INVARIANT:
        return w
    # Step 1b
    s = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s:
        stem_part = w[: -len(s)]
        if any(c in VOWELS for c in stem_part):
            w = stem_part
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _short_syllable_end(w):
                w += "e"
    # Step 1c
    if len(w) > 2 and w[-1] in "yY" and not _is_vowel(w, -2):
        w = w[:-1] + "i"
    # Step 2
    s = _longest(w, [x for x, _ in STEP2])
    if s and len(w) - len(s) >= r1:
        rep = dict(STEP2)[s]
        if s == "ogi":
            if w[-4:-3] == "l":
                w = w[:-3] + rep
        elif s == "li":
            if len(w) >= 3 and w[-3] in LI_ENDINGS:
                w = w[:-2]
        else:
            w = w[: -len(s)] + rep
    # Step 3
    s = _longest(w, [x for x, _ in STEP3])
    if s and len(w) - len(s) >= r1:
        if s == "ative":
            if len(w) - len(s) >= r2:
                w = w[:-5]
        else:
            w = w[: -len(s)] + dict(STEP3)[s]
    # Step 4
    s = _longest(w, STEP4)
    if s and len(w) - len(s) >= r2:
        if s == "ion":
            if len(w) >= 4 and w[-4] in "st":
                w = w[:-3]
        else:
            w = w[: -len(s)]
    # Step 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_syllable_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("l"):
        if len(w) - 1 >= r2 and w[-2:-1] == "l":
            w = w[:-1]
    return w.replace("Y", "y")


def _stems(tokens: pa.Array) -> pa.Array:
    words = tokens.dictionary_encode()
    return pa.array([stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Null arrays and null tokens stay null."""
    return pa.ListArray.from_arrays(tokens.offsets, _stems(tokens.values), mask=tokens.is_null())


@F.arrow_udf(T.StringType())
def stem_token(tokens: pa.Array) -> pa.Array:
    return _stems(tokens)


def stemmer(df: DataFrame, col: str) -> DataFrame:
    """Replace the token-array column ``col`` by its stems (plug-in for
    ``newsfeat.operators.textmining.corpus``)."""
    return df.withColumn(col, stem_tokens(F.col(col)))


def stem_vocabulary(tokens: Column, df: DataFrame) -> DataFrame:
    """Distinct tokens and their stems ``(token, stem)``."""
    # explode_outer: no inferred size filter re-running the tokenizer below.
    vocab = df.select(F.explode_outer(tokens).alias("token")).where(F.col("token").isNotNull()).distinct()
    return vocab.select("token", stem_token("token").alias("stem"))
