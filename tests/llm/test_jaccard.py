"""The n-gram Jaccard join against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsfeat.llm import jaccard as J

SCHEMA = "doc_id long, text string, n long, hi long, cls string"


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def families(seed, n=40):
    """Base texts with edited, cut and lengthened copies around the threshold."""
    rng = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(30))
    out = []
    for f in range(n):
        base = [f"w{rng.randint(0, 40 if f % 3 else 100_000)}" for _ in range(rng.choice([1, 3, 4, 5, 12, 30, 60, 150]))]
        if rng.random() < 0.4:
            base += common.split()
        for _ in range(rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, 1 + len(own) // 25)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9)}"
            cut = rng.randint(0, len(own) // 8)
            out.append(" ".join(own[cut:] if rng.random() < 0.5 else own + own[:cut]))
    return out


@pytest.mark.parametrize("seed,counted,list_rows", [(1, 5, 4096), (2, 1, 3), (3, 50, 10)])
def test_components_equal_all_pairs(spark, seed, counted, list_rows):
    texts = families(seed) + [None, "", " \t\n", None, "ONE", "one", "a b", "A  B\n", "a b c d", "\x1cx \x85y z q"]
    texts += texts[:20] + ["same words in every copy of this text"] * 60
    long = " ".join(f"v{i % 5000}" for i in range(60_000))
    texts += [long, long + " tail", long.upper(), "head " + long]
    ids = list(range(len(texts)))
    random.Random(seed).shuffle(ids)
    rows = [(None if i in (3, 9, 15) else 7_000_000_000 if i in (20, 21) else 2**62 + i if i % 50 == 0 else i, t)
            for i, t in zip(ids, texts)]
    rows += rows[5:9]
    df = spark.createDataFrame([(i, t, -1, 0, "clash") for i, t in rows], SCHEMA)
    got = J.jaccard_components(df, counted=counted, list_rows=list_rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain(rows)


def test_other_thresholds(spark):
    rows = list(enumerate(families(9, 30)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 70, 100):
        got = J.jaccard_components(df, percent=percent)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == plain(rows, percent)


def test_empty_table_and_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert J.jaccard_components(df.limit(0)).collect() == []
    assert sorted(tuple(r)[::2] + (r.component_id,) for r in J.jaccard_components(df).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_lists_hold_no_pairs_of_a_family(spark):
    """A thousand near copies: stars join them, so no candidate pair is left."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:i % 290] + [f"x{i}"] + base[i % 290 + 1:])) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = J.jaccard_components(df)
    assert out.select(F.min("component_id"), F.max("component_id")).first() == (0, 0)
