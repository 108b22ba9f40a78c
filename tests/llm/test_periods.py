"""Periodic runs against brute force: the recurrence, edge cases and the query."""

import hashlib
import random
import re
import zlib

import pytest

from newsfeat.llm import periods
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, runs string, n_words long, __w int"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(w, min_length=6, repeats=4):
    """Every stretch that repeats at a lag, tried lag by lag."""
    out = set()
    for p in range(1, len(w) // repeats + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            start, length = i - p, j - i + p
            if j > i and length >= max(min_length, repeats * p) and not any(
                    w[start + q:j] == w[start:j - q] for q in range(1, p)):
                out.add((start, length, p))
            i = j + 1
    return sorted(out)


def plain_collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in runs))


def plain_edit(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def plain_row(doc_id, text):
    w = plain_edit(doc_id, plain_words(text))
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *(best if best else (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(plain_collapsed(w, runs).encode()).hexdigest())


@pytest.mark.parametrize("seed", range(4))
def test_recurrence_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        w = []
        for _ in range(rng.randint(0, 12)):
            if w and rng.random() < 0.5:
                w += w[-rng.randint(1, min(len(w), 9)):] * rng.randint(1, 7)
            w += [rng.choice([b"a", b"b", b"c"][:rng.randint(1, 3)]) for _ in range(rng.randint(0, 4))]
            if rng.random() < 0.3:
                w.append(b"x%d" % rng.randint(0, 20))
        assert periods.runs_of(w) == plain_runs(w)
        assert periods.runs_of(w, 3, 2) == plain_runs(w, 3, 2)
        runs = plain_runs(w)
        assert b" ".join(periods.collapsed(w, runs)).decode() == plain_collapsed([x.decode() for x in w], runs)


def test_long_repeats_take_linear_time():
    assert periods.runs_of([b"ha"] * 300_000) == [(0, 300_000, 1)]
    block = [b"w%d" % (i % 40) for i in range(1000)] + [b"end"]
    assert (0, 100_100, 1001) in periods.runs_of(block * 100)


def test_operator_edges(spark):
    long = "one " + "la lu " * 60_000 + "two"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a"), (5, "a a a a a a"), (None, "b c " * 4), (6, "a\u00a0b " * 6),
            (6, "a\u00a0b " * 6), (7, long), (8, "\x1cx \x85y")]
    df = spark.createDataFrame([(i, t, "x", -1, 0) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.periodic_runs(df).collect()}
    assert got == {(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 5, (), "a a a a a"), (5, 6, ((0, 6, 1),), "a"),
                   (None, 8, ((0, 8, 2),), "b c"), (6, 6, ((0, 6, 1),), "a\u00a0b"),
                   (7, 120_002, ((1, 120_000, 2),), "one la lu two"), (8, 2, (), "\x1cx \x85y")}
    assert periods.periodic_runs(df).count() == len(rows)
    assert periods.periodic_runs(df.limit(0)).collect() == []
    edited = periods.with_repeated_tails(df)
    assert edited.columns == df.columns
    for before, after in zip(df.orderBy("doc_id").collect(), edited.orderBy("doc_id").collect()):
        want = plain_edit(before.doc_id, plain_words(before.text))
        assert plain_words(after.text) == want


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in periods.q_periods(spark, SF_SMALL).collect())
    assert got == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)
