"""Held-out accuracy, spans, Viterbi against brute force, odd rows."""

import itertools
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np

from newsfeat.llm import langid as li

DOCS = "doc_id long, text string, lang string, source string, score string"
SYLLABLES = {"en": "the ing er on st wh ly", "de": "ung sch ein für über ß tz", "fr": "eau é ou è que la tion", "ru": "ов ст пре ния ко да ли"}


def words(rng, lang, n):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=800):
    rng = random.Random(8)
    langs = list(SYLLABLES)
    return [(i, words(rng, langs[i % 4], rng.randint(3, 60)).capitalize() + ". 12!", langs[i % 4], "s", "clash") for i in range(n)]


def test_held_out_documents_and_odd_rows(spark):
    docs = corpus()
    odd = [(None, "the ing er on", "en", None, ""), (9000, None, "en", "", ""), (9001, "", None, "", ""), (9002, "12 ,. ́", "en", "", ""),
           (9003, "漢字かな", None, "", ""), (9004, "schein " * 60_000, None, "", ""), docs[0], docs[0]]
    df = spark.createDataFrame(docs + odd, DOCS)
    got = li.label_languages(df, li.fit(df)).select("doc_id", "__lang").collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r[1].score <= 1 for r in got)
    by_id = {r.doc_id: r[1].lang for r in got}
    assert [by_id[i] for i in (9000, 9001, 9002)] == ["und"] * 3
    assert by_id[9003] in SYLLABLES and by_id[9004] == "de"
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert sum(by_id[d[0]] == d[2] for d in held) / len(held) > 0.98


def test_spans_of_mixed_text(spark):
    rng = random.Random(1)
    df = spark.createDataFrame(corpus(), DOCS)
    parts = [("en", words(rng, "en", 30)), ("ru", words(rng, "ru", 10)), ("de", words(rng, "de", 40))]
    text = " , ".join(p for _, p in parts)
    row = li.label_languages(spark.createDataFrame([(1, text, None, None, None)], DOCS), li.fit(df)).first()["__lang"]
    assert [s["lang"] for s in row.spans] == ["en", "ru", "de"]
    assert [text[s["first"]:s["last"]] for s in row.spans] == [p for _, p in parts]
    assert row.lang == "de"


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 3, 0, 6, 1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(0, 3, (bounds[-1], 3)).astype(np.float32)
    labels = li.viterbi(scores, bounds, 2.0)

    def value(path, s):
        return sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
    for a, b in zip(bounds, bounds[1:]):
        s = scores[a:b].astype(float)
        best = max((value(p, s) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert abs(value(labels[a:b].tolist(), s) - best) < 1e-6


def test_words_and_long_runs():
    codes = li._codes("ab1 c\u0301d é! 漢字".encode())
    starts, ends = li.words_of(codes)
    assert list(zip(starts, ends)) == [(0, 2), (4, 7), (8, 9), (11, 13)]
    starts, ends = li.words_of(li._codes(("x" * (li.LONGEST * 2 + 5)).encode()))
    assert list(ends - starts) == [li.LONGEST, li.LONGEST, 5]


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame([(1, "some text", None, None, None)], DOCS)
    assert li.label_languages(df, li.fit(df)).first()["__lang"].lang == "und"
    none = spark.createDataFrame([], DOCS)
    assert li.label_languages(none, li.fit(none)).count() == 0


# ------------------------------------------------ the whole query, letter by letter
def plain_words(text):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and unicodedata.category(text[end])[0] in "LM":
            end += 1
        out += [(a, min(a + li.LONGEST, end)) for a in range(at, end, li.LONGEST)]
        at = max(end, at + 1)
    return [(a, b) for a, b in out if any(unicodedata.category(c)[0] == "L" for c in text[a:b])]


def plain_buckets(word):
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    edged = [1, *low, 1]
    for i in range(len(edged)):
        h = 0
        for n, c in enumerate(edged[i:i + max(li.ORDERS)], 1):
            h = (h * 0x9E3779B97F4A7C15 + c + n) % 2**64
            if n in li.ORDERS:
                yield ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 48) % li.BUCKETS


def plain_script(c):
    return [name for start, name in li.SCRIPTS if start <= ord(c)][-1]


def plain_labels(rows):
    """(lang, score, spans) of each text, learnt from the rows outside the fold."""
    grams, scripts = {}, {}
    for i, text, lang in rows:
        if i is not None and text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for a, b in plain_words(text):
                grams.setdefault(lang, Counter()).update(plain_buckets(text[a:b]))
                scripts.setdefault(lang, Counter())[plain_script(text[a])] += 1
    names = sorted(grams)
    total = {lang: 0.5 * li.BUCKETS + sum(grams[lang].values()) for lang in names}
    used = {lang: {s for s, n in scripts[lang].items() if n >= 0.02 * sum(scripts[lang].values())} for lang in names}
    out = []
    for _, text, _ in rows:
        found = plain_words(text or "")
        if not found or not names:
            out.append(("und", 0.0, []))
            continue
        best, back = None, []
        for a, b in found:
            word = text[a:b]
            say = [sum(math.log((grams[lang][g] + 0.5) / total[lang]) for g in plain_buckets(word)) for lang in names]
            say = [max(x - max(say), -li.WORD_SAY) for x in say]
            script = plain_script(word[0] if unicodedata.category(word[0])[0] == "L" else word[-1])
            if not any(script in used[lang] for lang in names):
                say = [0.0] * len(names)
            else:
                say = [x if script in used[lang] else -li.WORD_SAY - 50 for x, lang in zip(say, names)]
            say = [x - max(say) for x in say]
            if best is None:
                best = say
                continue
            top = best.index(max(best))
            back.append([top if best[top] - li.SWITCH > x else k for k, x in enumerate(best)])
            best = [max(x, best[top] - li.SWITCH) + y for x, y in zip(best, say)]
        path = [best.index(max(best))]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        weight = Counter()
        for (a, b), k in zip(found, path):
            weight[k] += b - a
        most = min(weight, key=lambda k: (-weight[k], k))
        spans = [(found[g[0]][0], found[g[-1]][1], names[k]) for k, g in
                 ((k, list(g)) for k, g in itertools.groupby(range(len(path)), key=path.__getitem__))]
        out.append((names[most], weight[most] / sum(weight.values()), spans))
    return out


def test_whole_query_same_as_plain_version(spark, tmp_path):
    rng = random.Random(21)
    rows = [r[:3] for r in corpus(120)]
    rows += [(1000 + i, " ".join(words(rng, rng.choice(list(SYLLABLES)), rng.randint(1, 6)) for _ in range(5)), None) for i in range(40)]
    rows += [(2000, None, "en"), (2001, "", "de"), (2002, "1 2 \u0301", None), (2003, "漢字 the über ов", "fr"),
             (2004, "x" * 100, None), (2005, "İstanbul \u0301a", "de"), (None, "the ing", "de"), (1, "the ing er", "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = li.q_langid(spark, str(tmp_path)).collect()
    want = plain_labels(rows)

    def digest(i, held, found):
        return (-1 if i is None else i, held, found[0], round(found[1], 9), len(found[2]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.lang_pred, round(r.score, 9), r.n_spans) for r in got) == sorted(
        digest(i, i is not None and zlib.crc32(str(i).encode()) % 4 == 2, w) for (i, _, _), w in zip(rows, want))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spans = [[tuple(s) for s in r["__lang"].spans] for r in li.label_languages(df, li.fit(df)).collect()]
    assert sorted(map(str, spans)) == sorted(str(w[2]) for w in want)
