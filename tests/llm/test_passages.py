"""Passage dedup against a plain model and the SQL form."""

import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from newsfeat.llm import passages as ps

SCHEMA = "doc_id long, text string, lang string, first int, digest string"


WS = " \t\n\r\f\x0b"


def plain_units(text):
    """[(start, end, words)] by walking over the characters."""
    out, start, at = [], 0, 0
    while at < len(text):
        if text[at] == "\n" or text[at] in ".!?" and text[at + 1:at + 2] and text[at + 1] in WS:
            at += 1
            while at < len(text) and text[at] in WS:
                at += 1
            out.append((start, at))
            start = at
        else:
            at += 1
    if start < len(text):
        out.append((start, len(text)))
    return [(a, b, re.findall(f"[^{WS}]+", text[a:b].lower())) for a, b in out]


def plain(rows, run_words=ps.RUN_WORDS):
    seen, out = set(), []
    for doc_id, text in rows:
        if text is None:
            out.append((doc_id, None, []))
            continue
        runs, before = [], False
        for a, b, words in plain_units(text):
            later = bool(words) and tuple(words) in seen
            seen.add(tuple(words))
            if later and before:
                runs[-1] = (runs[-1][0], b, runs[-1][2] + len(words))
            elif later:
                runs.append((a, b, len(words)))
            before = later
        cut = [(a, b) for a, b, n in runs if n >= run_words]
        keep, at = "", 0
        for a, b in cut:
            keep, at = keep + text[at:a], b
        out.append((doc_id, keep + text[at:], cut))
    return out


def corpus(n=200):
    rng = random.Random(6)
    shared = [" ".join(f"p{k}w{j}" + rng.choice(["", "", "", ".", "!"]) for j in range(rng.choice([5, 19, 20, 60]))) for k in range(12)]
    rows = []
    for i in range(n):
        lines = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            if rng.random() < 0.5:
                p = "so it was. " + p + rng.choice(["", ".", "?"]) + rng.choice(["", " and so on."])
            lines.insert(rng.randint(0, len(lines)), p.upper() if rng.random() < 0.3 else "  " + p.replace(" ", "  ", 2))
        rows.append((i, "\n".join(lines) + rng.choice(["", "\n"])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "é\U0001f600 " + shared[2] + "\n" + shared[2] + "\n" + "\n".join(f"a b c d e f g h {i % 900}" for i in range(30_000)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 3, "clash") for i, t in rows], SCHEMA)


def test_same_as_plain_model_and_sql(spark):
    rows = corpus()
    out = ps.substring_dedup(frame(spark, rows))
    assert out.columns == [*frame(spark, rows).columns, "removed"]
    got = {r.doc_id: (r.text, [(s["first"], s["last"]) for s in r.removed]) for r in out.collect()}
    assert got == {i: (t, cut) for i, t, cut in plain(rows)}
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])
    want = duckdb.connect().register("documents", documents).sql(ps.SQL).fetchall()
    have = out.select("doc_id", "text", F.to_json("removed"), F.size("removed")).collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in have)


def test_long_passage_goes_and_clean_text_stays(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "intro of one\n" + passage + "\nend of one"), (2, "other\n" + passage), (3, "clean text\nof its own"),
            (4, "It begins here. " + passage + ". And goes on."), (5, "Other words first! " + passage + ". And then?")]
    got = {r.doc_id: r.text for r in ps.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "other\n", 3: rows[2][1], 4: rows[3][1], 5: "Other words first! And then?"}


def test_lines_and_paragraphs(spark):
    para = "a b c d e f g h\ni j k l"
    rows = [(1, para + "\n\nx"), (2, "y\n \n" + para + "\n\n\nz")]
    got = {r.doc_id: r.text for r in ps.substring_dedup(frame(spark, rows), unit=ps.PARAGRAPH, run_words=12).collect()}
    assert got == {1: rows[0][1], 2: "y\n \nz"}
    got = {r.doc_id: r.text for r in ps.substring_dedup(frame(spark, rows), unit=ps.LINE, run_words=12).collect()}
    assert got == {1: rows[0][1], 2: "y\n \n\n\nz"}
    got = {r.doc_id: r.text for r in ps.substring_dedup(frame(spark, rows), unit=ps.LINE, run_words=13).collect()}
    assert got == dict(rows)


def test_null_ids_repeated_rows_empty_table(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(None, line), (4, line), (4, line), (None, line + " nine"), (6, "x\n" + line)]
    got = sorted(((r.doc_id or 0), r.text) for r in ps.substring_dedup(frame(spark, rows)).collect())
    assert got == [(0, ""), (0, line + " nine"), (4, line), (4, line), (6, "x\n")]
    assert ps.substring_dedup(frame(spark, [])).count() == 0
