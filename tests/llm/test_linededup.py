"""Line chunks against a plain model and the SQL form."""

import hashlib
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from newsfeat.llm import linededup as ld

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, first int"


def chunks(text):
    lines = text.split("\n")
    prev, out, at = 0, [], 0
    for i, line in enumerate(lines):
        h = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        if (prev * ld.BASE + h) % ld.PRIME % ld.EVERY == 0 or i == len(lines) - 1:
            out.append((at, i))
            at = i + 1
        prev = h
    return lines, out


def plain(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            out[doc_id] = None
            continue
        lines, parts = chunks(text)
        keep = []
        for a, b in parts:
            block = lines[a:b + 1]
            if sum(1 for x in block if x.strip(" ")) >= ld.MIN_LINES and len(block) >= ld.MIN_LINES:
                if tuple(block) in seen:
                    continue
                seen.add(tuple(block))
            keep += block
        out[doc_id] = "\n".join(keep)
    return out


def corpus(n=300):
    rng = random.Random(2)
    pool = [f"line {i} of the pool" for i in range(60)] + ["", "  ", "é"]
    shared = [[rng.choice(pool) + f" s{k}" for _ in range(12)] for k in range(4)]
    rows = []
    for i in range(n):
        own = [f"own {i} {j}" if rng.random() < 0.7 else rng.choice(pool) for j in range(rng.randint(0, 30))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + (rng.choice(shared) if rng.random() < 0.5 else []) + own[at:])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n\n"), (n + 3, "\n".join(f"x{i % 7}" for i in range(20_000)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 9) for i, t in rows], SCHEMA)


def test_same_as_plain_model(spark):
    rows = corpus() + [(None, "a\nb\nc\nd\ne\nf"), (1000, "a\nb\nc\nd\ne\nf")]
    out = ld.line_dedup(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    got = {r.doc_id: r for r in out.collect()}
    want = plain(rows)
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    assert sum(r.text != t for (i, t), r in ((x, got[x[0]]) for x in rows)) > 50


def test_same_as_sql(spark):
    rows = corpus(120)
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    want = duckdb.connect().register("documents", documents).sql(ld.SQL).fetchall()
    df = ld.line_dedup(frame(spark, rows), removed_col="removed").select("doc_id", "text", F.to_json("removed"))
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(r[:3]) for r in want)


def test_chunks_of_a_passage_survive_a_shift(spark):
    passage = [f"passage {i}" for i in range(40)]
    rows = [(1, "\n".join(passage)), (2, "\n".join(["intro", "more"] + passage + ["end"]))]
    got = {r.doc_id: r.text.split("\n") for r in ld.line_dedup(frame(spark, rows)).collect()}
    assert got[1] == passage and len(got[2]) < 15 and got[2][0] == "intro"


def test_equal_hashes_with_other_bytes_stay(spark, monkeypatch):
    rows = corpus(80)
    monkeypatch.setattr(ld.F, "xxhash64", lambda c, f=F.xxhash64: f(c) % 7 if str(c) == "chunk" else f(c))
    assert {r.doc_id: r.text for r in ld.line_dedup(frame(spark, rows)).collect()} == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "a\nb\nc\nd")]
    got = sorted((r.doc_id, r.text) for r in ld.line_dedup(frame(spark, rows)).collect())
    assert got[:2] == [(1, "a\nb\nc\nd")] * 2 and got[2] != (2, "a\nb\nc\nd")
    assert ld.line_dedup(frame(spark, [])).count() == 0


def plain_runs(rows):
    """Every later pair of neighbouring written lines is cut, but for lines of its own first occurrence."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (text or "").split("\n")
        written = [i for i, x in enumerate(lines) if x.strip(" ")]
        cut = set()
        for a, b in zip(written, written[1:]):
            kept_doc, kept = seen.setdefault("\n".join(lines[a:b + 1]), (doc_id, range(a, b + 1)))
            if kept != range(a, b + 1) or kept_doc != doc_id:
                cut |= set(range(a, b + 1)) - (set(kept) if kept_doc == doc_id else set())
        out[doc_id] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in cut)
    return out


def test_short_runs_are_cut_wherever_they_stand(spark):
    rows, want = [], {}
    for n in (2, 3, 4, 5):
        for k in range(20):
            passage = [f"passage {n} {k} line {j}" for j in range(n)]
            for copy in (0, 1):
                i = len(rows)
                own = [f"own {i} {j}" for j in range(k % 4 + copy)], [f"after {i}"] * (k % 2)
                rows.append((i, "\n".join(own[0] + passage + own[1])))
                want[i] = "\n".join(own[0] + own[1]) if copy else rows[-1][1]
    assert {r.doc_id: r.text for r in ld.line_dedup(frame(spark, rows), runs=True).collect()} == want


def test_runs_same_as_plain_model(spark, monkeypatch):
    rows = corpus() + [(None, "a\nb\nc"), (1000, "a\nb\n\nc"), (1001, "z\n\nb\n\nc\ny"), (1002, "x\nx\nx\nx\nx")]
    want = plain_runs(rows)
    out = ld.line_dedup(frame(spark, rows), runs=True)
    assert out.columns == frame(spark, rows).columns
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.text for k, r in got.items()} == want and want[1002] == "x\nx"
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    lines = [set("\n".join(t or "" for t in texts).split("\n")) - {"", "  "} for texts in (want.values(), dict(rows).values())]
    assert lines[0] == lines[1]
    assert ld.line_dedup(frame(spark, []), runs=True).count() == 0
    monkeypatch.setattr(ld.F, "xxhash64", lambda c, f=F.xxhash64: f(c) % 7 if str(c) == "chunk" else f(c))
    assert {r.doc_id: r.text for r in ld.line_dedup(frame(spark, rows), runs=True).collect()} == want
