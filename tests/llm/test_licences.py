"""Licence rules on planted texts, and the SQL form."""

import random
import re

import duckdb
import pandas as pd

from newsfeat.llm import licences as lc

SCHEMA = "doc_id long, text string, licence string, rule string, norm string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA)


def cases():
    s = lc.SENTENCES
    apache = ". ".join(s[x] for x in ("apache-header", "apache-use")) + "."
    wrapped = "/*\n" + "\n".join(" * " + x for x in re.findall(r".{1,50}(?: |$)", s["mit-grant"] + ": " + s["mit-keep"] + ". " + s["mit-as-is"] + ".")) + "\n */"
    return {
        1: (apache, "Apache-2.0"), 2: ("Some prose here.\n" + s["mit-notice"] + ".\nMore prose.", "MIT"),
        3: ("prose without stop\n" + s["gpl3-work"].upper() + "\nmore", "GPL-3.0-only"),
        4: ("code\n" + wrapped + "\nint x;", "MIT"),
        5: (f"{s['bsd-grant']}:\n{s['bsd-source']}.\n{s['bsd-binary']}.", "BSD-2-Clause"),
        6: (f"{s['cc-by-nc-4']}. {s['all-rights']}.", "All-Rights-Reserved,CC-BY-NC-4.0"),
        7: ("This is about licensing in general. Permission is nice.", None), 8: (None, None), 9: ("", None),
        10: ("word " * 50_000 + "\n" + s["apache-notice"] + ".", "Apache-2.0"),
        11: ("not Licensed under the MIT License", None),
    }


def test_planted_texts(spark):
    rows = [(i, t) for i, (t, _) in cases().items()]
    got = {r.doc_id: r.licences for r in lc.licences(frame(spark, rows + rows[:2] + [(None, rows[1][1])])).collect()}
    assert got == {**{i: want for i, (_, want) in cases().items() if want}, None: "MIT"}


def test_same_as_sql(spark):
    rng = random.Random(3)
    known = list(lc.SENTENCES.values())
    rows = [(i, t) for i, (t, _) in cases().items() if i != 10]
    rows += [(100 + i, rng.choice(["", "a b. "]) + rng.choice([". ", ".\n", ";\n", "\n# "]).join(
        rng.choice(known) if rng.random() < 0.7 else "prose" for _ in range(rng.randint(1, 6)))) for i in range(200)]
    want = duckdb.connect().register("documents", pd.DataFrame(rows, columns=["doc_id", "text"])).sql(lc.SQL).fetchall()
    got = [tuple(r) for r in lc.licences(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100


def test_markers_and_rules_are_complete():
    marker = re.compile(lc.MARKERS, re.I)
    assert all(marker.search(x) for x in lc.SENTENCES.values())
    assert {s for _, _, sids in lc.RULES for s in sids} <= set(lc.SENTENCES)
    assert len({wanted for _, _, wanted in lc.rule_sequences()}) == len(lc.RULES)


def test_sentences_wrapped_at_each_space_match(spark):
    rules = {sids[0]: licence for licence, _, sids in lc.RULES if len(sids) == 1}
    rows, want = [], {}
    for sid, licence in rules.items():
        words = (lc.SENTENCES[sid] + ".").split(" ")
        for at in range(1, len(words)):
            for gap in ("\n", "  ", "\r\n", "\n# "):
                want[len(rows)] = licence
                rows.append((len(rows), " ".join(words[:at]) + gap + " ".join(words[at:])))
    got = {r.doc_id: r.licences.split(",") for r in lc.licences(frame(spark, rows)).collect()}
    assert [(t, want[i]) for i, t in rows if want[i] not in got.get(i, [])] == []


def test_every_rule_fires_alone(spark):
    rows = [(i, ".\n".join(lc.SENTENCES[s] for s in sids) + ".") for i, (_, _, sids) in enumerate(lc.RULES)]
    got = {}
    for r in lc.licence_matches(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.licence, r.rule))
    assert all((licence, rule) in got[i] for i, (licence, rule, _) in enumerate(lc.RULES))


def test_empty_table(spark):
    assert lc.licences(frame(spark, [])).count() == 0


def real_texts():
    """Texts as files carry them: numbered or starred lists, addresses, copyright lines, wrapped."""
    s = lc.SENTENCES

    def wrap(text, mark=""):
        return "\n".join(mark + x.rstrip() for x in re.findall(r".{1,60}(?: |$)", text))

    def bsd(marks, keys):
        return "\n\n".join(["Copyright (c) 2019, A. Nobody and others", s["all-rights"] + ".", wrap(s["bsd-grant"] + ":")]
                           + [wrap(f"{m} {s[k]}.") for m, k in zip(marks, keys)] + ["THIS SOFTWARE IS PROVIDED AS IT IS."])

    three = ("bsd-source", "bsd-binary", "bsd-name")
    notice = "\n\n".join([wrap(s["apache-header"] + ";") + "\n" + wrap(s["apache-use"] + ".") + "\n" + s["apache-copy"],
                          "    http://www.apache.org/licenses/LICENSE-2.0", wrap(s["apache-basis"] + "."), wrap(s["apache-see"] + ".")])
    mit = "\n\n".join([s["mit-title"], "Copyright (c) 2015 Some Body", "Copyright (c) 2016, 2017 Other Body <o@b.example>",
                       wrap(s["mit-grant"] + ":"), wrap(s["mit-keep"] + "."), wrap(s["mit-as-is"] + ".")])
    return [
        *[(bsd(m, three), "BSD-3-Clause:full text") for m in (("1.", "2.", "3."), ("*", "*", "*"), ("1)", "2)", "3)"), ("(1)", "(2)", "(3)"), ("a.", "b.", "c."))],
        *[(bsd(m, three[:2]), "BSD-2-Clause:full text") for m in (("1.", "2."), ("-", "-"))],
        (notice, "Apache-2.0:full notice"), ("\n".join("# " + x for x in notice.split("\n")), "Apache-2.0:full notice"),
        (mit, "MIT:full text"), ("\n".join(mit.split("\n\n")[:3]) + "\n" + s["mit-grant"] + ":\n", "MIT:title and grant"),
        (f"{s['isc-title']}\n\nCopyright 2004-2010 X\n\n{wrap(s['isc-grant'])}.\n\n{wrap(s['isc-as-is'])}.", "ISC:full text"),
        (f"{wrap(s['mpl2-notice'])}. {wrap(s['mpl2-copy'])}.", "MPL-2.0:full notice"),
        ("   Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n", "Apache-2.0:title"),
        ("  GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n "
         + wrap(s["gpl-verbatim"]) + ".\n\n  Preamble\n", "GPL-3.0-only:full text"),
        ("  GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n", "GPL-2.0-only:title"),
        ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "GPL-2.0-only:tag"),
        ("/* SPDX-License-Identifier: LGPL-2.1-or-later */\nint x;", "LGPL-2.1-or-later:tag"),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0\n", "MIT OR Apache-2.0:tag"),
    ]


def test_texts_as_files_carry_them(spark):
    rows = [(i, t) for i, (t, _) in enumerate(real_texts())]
    got = {r.doc_id: r.rules.split(",") for r in lc.licences(frame(spark, rows)).collect()}
    assert [(t, want, got.get(i)) for i, (t, want) in enumerate(real_texts()) if want not in got.get(i, [])] == []
    want = duckdb.connect().register("documents", pd.DataFrame(rows, columns=["doc_id", "text"])).sql(lc.SQL).fetchall()
    assert sorted(tuple(r) for r in lc.licences(frame(spark, rows)).collect()) == sorted(want)


def test_wrapped_markers_same_as_sql(spark):
    rows = [(1, "This work is in the public\n  domain."), (2, "All rights\r\nreserved."), (3, "x.\n# All rights\n# reserved.")]
    want = duckdb.connect().register("documents", pd.DataFrame(rows, columns=["doc_id", "text"])).sql(lc.SQL).fetchall()
    assert sorted(tuple(r) for r in lc.licences(frame(spark, rows)).collect()) == sorted(want) and len(want) == 3
