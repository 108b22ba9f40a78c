"""The pipeline's stages against plain versions, each on the rows it was given."""

import hashlib
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from newsfeat.llm import mixing
from tests.llm.test_bpe import reference  # noqa: F401
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def plain_mix(rows):
    """Copies of each document: {doc_id: number of copies that are read}."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    by_source = {}
    for d, t, s in rows:
        by_source.setdefault(s, []).append((hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest(), d))
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d] for _, d in by_source[s]) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 2 * total[s] for s in capped}
        over = {s for s in free if target[s] >= 2 * total[s]}
        if not over:
            break
        capped |= over
    copies = Counter()
    for s in names:
        wanted, start = int(target[s] + 0.5), 0
        for epoch in range(2):
            for _, d in sorted(by_source[s]):
                words = min(size[d], max(0, wanted - start))
                if words and 2 * words >= size[d]:
                    copies[d] += 1
                start += size[d]
    return copies


def test_stages_match_plain_versions(spark, reference):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = corpus_pipeline.written_table(out, "test-stage")
        seen.append(docs.collect())
    given, clean, cut, kept, mixed, coded = seen
    assert {r.doc_id for r in clean} <= {r.doc_id for r in given} and len(clean) > 0.8 * len(given)
    assert {r.doc_id: r.text for r in cut} == plain_lines([(r.doc_id, r.text) for r in clean])
    groups = plain_components([r.doc_id for r in cut], [plain_fingerprint(r.text) for r in cut])
    assert sorted(r.doc_id for r in kept) == sorted({g for g in groups})
    assert Counter(r.doc_id for r in mixed) == plain_mix([(r.doc_id, r.text, r.source) for r in kept])
    want = []
    for r in mixed:
        ids = np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, coded)) == sorted(want)


def test_stages_keep_odd_rows_going(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "a\nb\nc\nd\ne", None, None, None),
            (3, "x " * 50_000, "en", "a", 100_000), (4, "x " * 50_000, "en", "b", 100_000)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.written_table(stage(spark, docs, SF), "test-odd")
        assert (docs.count() > 0) == bool(data)


def test_stage_list():
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
