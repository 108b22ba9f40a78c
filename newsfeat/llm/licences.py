"""Licence scans by sentence rules, in DataFrame expressions only.

Texts are cut into sentences, sentences are normalised and looked up in a table
of known licence sentences, and the sequence of identifiers of neighbouring
known sentences is matched against ordered rules: an earlier rule takes its
sentences before a later one can.  Web addresses, list numbers and copyright
lines are skipped, so they don't part the sentences around them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsfeat.llm.common import read

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-notice": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-short": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "Licensed under the BSD License",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl2-work": "This work is licensed under the GNU General Public License, version 2",
    "gpl3-licensed": "Licensed under the GNU General Public License, version 3",
    "gpl2-licensed": "Licensed under the GNU General Public License, version 2",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "lgpl3-licensed": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl3-licensed": "Licensed under the GNU Affero General Public License, version 3",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl2-licensed": "Licensed under the Mozilla Public License, Version 2.0",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0",
    "cc-by-4": "Licensed under CC BY 4.0",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0",
    "cc-by-4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "public-domain": "This work is in the public domain",
    "all-rights": "All rights reserved",
    "mit-expat": "Distributed under the MIT License",
    "isc-title": "ISC License",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "bsd2-title": "BSD 2-Clause License",
    "bsd3-title": "BSD 3-Clause License",
    "apache-title": "Apache License Version 2.0, January 2004",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed",
}
# Licence and the identifiers that make a match, the first rule first.
RULES = [
    ("GPL-3.0-only", "full text", ("gpl3-title", "gpl-verbatim")),
    ("AGPL-3.0-only", "full text", ("agpl3-title", "gpl-verbatim")),
    ("LGPL-3.0-only", "full text", ("lgpl3-title", "gpl-verbatim")),
    ("Apache-2.0", "full notice", ("apache-header", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", "header", ("apache-header", "apache-use")),
    ("BSD-3-Clause", "full text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", "full text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-1-Clause", "full text", ("bsd-grant", "bsd-source")),
    ("MIT", "full text", ("mit-grant", "mit-keep", "mit-as-is")),
    ("MIT", "grant", ("mit-grant", "mit-keep")),
    ("MIT", "title and grant", ("mit-title", "mit-grant")),
    ("GPL-3.0-or-later", "full notice", ("gpl3-later", "gpl-warranty", "gpl-details")),
    ("GPL-3.0-or-later", "notice", ("gpl3-later",)),
    ("GPL-2.0-or-later", "full notice", ("gpl2-later", "gpl-warranty", "gpl-details")),
    ("GPL-2.0-or-later", "notice", ("gpl2-later",)),
    ("MPL-2.0", "full notice", ("mpl2-notice", "mpl2-copy")),
    ("MPL-2.0", "notice", ("mpl2-notice",)),
    ("Apache-2.0", "reference", ("apache-notice",)),
    ("Apache-2.0", "reference", ("apache-header",)),
    ("MIT", "reference", ("mit-notice",)),
    ("MIT", "reference", ("mit-licensed",)),
    ("MIT", "title", ("mit-title",)),
    ("MIT", "title", ("mit-short",)),
    ("MIT", "grant alone", ("mit-grant",)),
    ("ISC", "full text", ("isc-grant", "isc-as-is")),
    ("ISC", "grant", ("isc-grant",)),
    ("BSD-3-Clause", "reference", ("bsd-notice",)),
    ("GPL-3.0-only", "reference", ("gpl3-work",)),
    ("GPL-3.0-only", "reference", ("gpl3-licensed",)),
    ("GPL-2.0-only", "reference", ("gpl2-work",)),
    ("GPL-2.0-only", "reference", ("gpl2-licensed",)),
    ("LGPL-3.0-only", "reference", ("lgpl3-licensed",)),
    ("AGPL-3.0-only", "reference", ("agpl3-licensed",)),
    ("MPL-2.0", "reference", ("mpl2-licensed",)),
    ("CC-BY-NC-SA-4.0", "reference", ("cc-by-nc-sa-4",)),
    ("CC-BY-NC-4.0", "reference", ("cc-by-nc-4",)),
    ("CC-BY-NC-4.0", "reference", ("cc-by-nc-4-long",)),
    ("CC-BY-SA-4.0", "reference", ("cc-by-sa-4",)),
    ("CC-BY-SA-4.0", "reference", ("cc-by-sa-4-long",)),
    ("CC-BY-ND-4.0", "reference", ("cc-by-nd-4",)),
    ("CC-BY-4.0", "reference", ("cc-by-4",)),
    ("CC-BY-4.0", "reference", ("cc-by-4-long",)),
    ("CC0-1.0", "waiver", ("cc0-notice",)),
    ("Unlicense", "notice", ("unlicense",)),
    ("Public-Domain", "notice", ("public-domain",)),
    ("MIT", "reference", ("mit-expat",)),
    ("ISC", "title", ("isc-title",)),
    ("BSD-2-Clause", "title", ("bsd2-title",)),
    ("BSD-3-Clause", "title", ("bsd3-title",)),
    ("Apache-2.0", "title", ("apache-title",)),
    ("GPL-3.0-only", "title", ("gpl3-title",)),
    ("GPL-2.0-only", "title", ("gpl2-title",)),
    ("LGPL-3.0-only", "title", ("lgpl3-title",)),
    ("LGPL-2.1-only", "title", ("lgpl21-title",)),
    ("AGPL-3.0-only", "title", ("agpl3-title",)),
    ("MPL-2.0", "title", ("mpl2-title",)),
    ("All-Rights-Reserved", "reservation", ("all-rights",)),
]
# Licence identifiers of a tag.  Each is a sentence and a rule of its own.
TAGS = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-1-Clause", "BSD-2-Clause",
        "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
        "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only",
        "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
        "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
        "Apache-2.0 OR MIT", "MIT OR Apache-2.0"]
SENTENCES |= {f"spdx-{tag}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
RULES += [(tag, "tag", (f"spdx-{tag}",)) for tag in TAGS]
# Every known sentence holds one of these (a test sees to it), so texts without
# any of them have no match and are not cut up.
MARKERS = "licen[cs]e|licensed|permi|redistribut|warrant|copyright|public domain|free software|rights reserved|mpl"

_SPACE = r"[ \t\n\r\f]"
_GAP = r"\n[ \t]*[*#/-]*[ \t]*\n"           # a line that is blank or a comment mark alone
_WRAP = r"\n[ \t]*(?:[*#/]+|--)?[ \t]*"     # a line break and a comment mark after it
_STOP = rf"([.!?;:])({_SPACE}+)"            # the end of a sentence
_URL = r"https?://[^ \t\n\r\f]*[^ \t\n\r\f.,;:!?)>]"
_LISTED = r"^[ \t\r\f*#/-]*[(]?(?:[0-9]{1,2}|[abd-zABD-Z])[)]"  # "1)", "(a)"; "(c)" is a copyright sign
_OTHER = "[^a-z0-9]+"
# Normalised sentences to skip: empty ones, list numbers, copyright lines.
_SKIPPED = ("^(?:[0-9]{1,2}|[a-z]|[ivx]{2,4}|c [0-9]{4}.{0,200}"
            "|(?:portions )?(?:c )?copyright (?:c |[^0-9]{0,80}[0-9]{4}).{0,200}|)$")
# The markers as texts have them: the match is on normalised sentences, so any
# run of other characters (a wrapped line, a second space) may part two words.
_MARKED = MARKERS.replace(" ", _OTHER)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), _OTHER, " "))


def parts() -> tuple[dict[str, str], dict[str, str]]:
    """Sentences cut at their inner stops, as texts are: {identifier: normalised
    part}, and {sentence identifier: its parts' identifiers, each in <>}.  Equal
    parts of two sentences share an identifier."""
    known: dict[str, str] = {}
    sequence = {}
    for sid, sentence in SENTENCES.items():
        plain = re.sub(_URL, " ", sentence)
        own = [re.sub(_OTHER, " ", x.lower()).strip() for x in re.split(_STOP.replace("(", "(?:"), plain)]
        for n, norm in enumerate(own):
            known.setdefault(norm, sid if len(own) == 1 else f"{sid}#{n}")
        sequence[sid] = "".join(f"<{known[norm]}>" for norm in own)
    return {pid: norm for norm, pid in known.items()}, sequence


def known_sentences(spark: SparkSession) -> DataFrame:
    """``(sid, norm)``: the table of known sentences and parts."""
    return spark.createDataFrame(list(parts()[0].items()), "sid string, norm string")


def rule_sequences() -> list[tuple[str, str, str]]:
    """(licence, rule, identifiers in <>) in the order of the rules."""
    sequence = parts()[1]
    return [(licence, rule, "".join(sequence[s] for s in sids)) for licence, rule, sids in RULES]


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_hash, reading, pos, norm)``.  Two readings of each text:
    ``lines`` ends sentences at line breaks too, ``joined`` undoes wrapped lines
    and comment marks (a blank line or a lone comment mark ends a sentence).
    Skipped sentences are not numbered."""
    text = F.col("text")
    marked = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
              .where(text.rlike(f"(?i){_MARKED}")))
    both = marked.withColumn("way", F.explode(F.array(
        F.struct(F.lit("lines").alias("reading"), text.alias("t")),
        F.struct(F.lit("joined").alias("reading"), F.regexp_replace(F.regexp_replace(text, _GAP, ".\n"), _WRAP, " ").alias("t")))))
    cut = F.split(F.regexp_replace(F.regexp_replace("way.t", _URL, " "), _STOP, "$1\n"), "\n")
    norm = F.transform(cut, lambda x: normalised(F.regexp_replace(x, _LISTED, " ")))
    return (both.select("doc_id", F.xxhash64("text").alias("text_hash"), "way.reading",
                        F.filter(norm, lambda x: ~x.rlike(_SKIPPED)).alias("parts"))
            .select("doc_id", "text_hash", "reading", F.posexplode_outer("parts").alias("pos", "norm"))
            .where("norm IS NOT NULL"))


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, reading, first, last, licence, rule)``: a row for
    each rule that a run of neighbouring known sentences (numbers ``first`` to
    ``last``) satisfies.

    The table of sentences is fixed and small, so it is broadcast; only known
    sentences are shuffled.  Null and empty texts have no match; repeated rows
    of one text count once; an empty table gives no rows.
    """
    known = sentences(docs, id_col, text_col).join(F.broadcast(known_sentences(docs.sparkSession)), "norm").drop("norm").distinct()
    text = ["doc_id", "text_hash", "reading"]
    numbered = known.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*text).orderBy("pos")))
    runs = numbered.groupBy(*text, "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sid"))),
                                 lambda x: F.concat(F.lit("<"), x["sid"], F.lit(">"))), "").alias("left0"))
    hits = []
    for i, (licence, rule, wanted) in enumerate(rule_sequences()):
        hits.append(F.when(F.contains(f"left{i}", F.lit(wanted)), F.struct(F.lit(licence).alias("licence"), F.lit(rule).alias("rule"))))
        runs = runs.withColumn(f"left{i + 1}", F.replace(f"left{i}", F.lit(wanted), F.lit("<>")))
    return (runs.select(*text, "first", "last", F.explode(F.array_distinct(F.array_compact(F.array(*hits)))).alias("m"))
            .select(*text, "first", "last", "m.licence", "m.rule"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, licences, rules)`` of the documents with a match, both sorted
    and joined by commas; rows that share an id are joined."""
    return licence_matches(docs, id_col, text_col).groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("licences"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "licence", "rule"))), ",").alias("rules"))


def q_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(read(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql() -> str:
    def norm(x):
        return f"trim(regexp_replace(lower({x}), '{_OTHER}', ' ', 'g'))"

    def esc(x):
        return x.replace("\n", "\\n")

    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in parts()[0].items())
    chain, hits = "", []
    for i, (licence, rule, wanted) in enumerate(rule_sequences()):
        wanted = _quoted(wanted)
        source = f"l{i}"
        chain += f", l{i + 1} AS (SELECT *, contains(s{i}, {wanted}) AS h{i}, replace(s{i}, {wanted}, '<>') AS s{i + 1} FROM {source})"
        hits.append(f"SELECT doc_id, {_quoted(licence)} AS licence, {_quoted(rule)} AS rule FROM l{len(RULES)} WHERE h{i}")
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) v(sid, norm)),
m AS (SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i){_MARKED}')),
w AS (SELECT doc_id, 'lines' AS reading, text AS t FROM m
      UNION ALL SELECT doc_id, 'joined', regexp_replace(regexp_replace(text, '{esc(_GAP)}', '.' || chr(10), 'g'), '{esc(_WRAP)}', ' ', 'g') FROM m),
c AS (SELECT doc_id, reading, string_split(regexp_replace(regexp_replace(t, '{esc(_URL)}', ' ', 'g'),
             '{esc(_STOP)}', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM w),
s AS (SELECT doc_id, reading, generate_subscripts(parts, 1) AS nth, unnest(parts) AS sentence FROM c),
x AS (SELECT doc_id, reading, nth, {norm(f"regexp_replace(sentence, '{_LISTED}', ' ')")} AS norm FROM s),
p AS (SELECT doc_id, reading, norm, row_number() OVER (PARTITION BY doc_id, reading ORDER BY nth) AS pos
      FROM x WHERE NOT regexp_matches(norm, '{_SKIPPED}')),
k AS (SELECT doc_id, reading, pos, sid FROM p JOIN known USING (norm)),
n AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, reading ORDER BY pos) AS run FROM k),
l0 AS (SELECT doc_id, string_agg('<' || sid || '>', '' ORDER BY pos) AS s0 FROM n GROUP BY doc_id, reading, run){chain},
hit AS ({' UNION '.join(hits)})
SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences,
       string_agg(DISTINCT licence || ':' || rule, ',' ORDER BY licence || ':' || rule) AS rules
FROM hit GROUP BY doc_id"""


SQL = _sql()
