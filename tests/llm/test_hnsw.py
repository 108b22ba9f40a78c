"""Recall against brute force, exact scores, odd vectors and copies."""

import numpy as np

from newsfeat.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim string"


def frame(spark, ids, rows):
    return spark.createDataFrame([(i, None if r is None else [None if x is None else float(x) for x in r], 0, "clash", "clash")
                                  for i, r in zip(ids, rows)], SCHEMA)


def brute(ids, rows, queries, top=20):
    rows = np.asarray(rows, np.float32).astype(float)
    out = {}
    for q in queries:
        score = rows @ rows[ids.index(q)]
        out[q] = [(ids[i], score[i]) for i in sorted(range(len(ids)), key=lambda i: (-score[i], ids[i])) if ids[i] != q][:top]
    return out


def run(spark, ids, rows, shard_rows=400, **options):
    clean = hnsw.clean(frame(spark, ids, rows), "vec_id", "embedding")
    found = {}
    for r in hnsw.search(hnsw.build_index(clean, shard_rows), clean.where("vec_id % 20 = 0"), **options).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(x)] for q, x in found.items()}


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2500, 32)) * rng.uniform(0.3, 2, (2500, 1))
    rows[:500] = rows[:500].mean(0) + rng.normal(size=(500, 32)) * 0.05  # a tight cluster
    ids = rng.permutation(10_000)[:2500].tolist()
    queries = [i for i in ids if i % 20 == 0]
    got, want = run(spark, ids, rows), brute(ids, rows, queries)
    assert set(got) == set(want)
    exact = {i: r for i, r in zip(ids, rows.astype(np.float32).astype(float))}
    hits = 0
    for q in queries:
        assert len(got[q]) == 20 and q not in [v for v, _ in got[q]]
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        assert all(abs(s - exact[q] @ exact[v]) < 1e-9 for v, s in got[q])
        hits += len({v for v, _ in got[q]} & {v for v, _ in want[q]})
    assert hits / (20 * len(queries)) >= 0.95


def test_copies_tie_to_smaller_ids(spark):
    rows = [[1.0, 2.0, 0.5]] * 300 + [[0.1 * i, 1.0, -1.0] for i in range(100)]
    ids = list(range(400))
    got, want = run(spark, ids, rows, 50), brute(ids, rows, range(0, 400, 20))
    for q in range(0, 300, 20):
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1, 0], [0, 0], None, [1, None], [nan, 1], [inf, 1], [], [0.5, 0.5], [2, 1], [1, 2, 3], [1, 1, 1], [1, 0]]
    ids = [0, 1, 20, 3, 40, 5, 60, 7, 8, 80, 9, 0]
    got = run(spark, ids, rows)
    assert got[0] == [(8, 2.0), (7, 0.5)] and got[80] == [(9, 6.0)] and set(got) == {0, 80}
    assert run(spark, [None], [[1, 2]]) == {} and run(spark, [], []) == {}
    assert run(spark, [20], [[1, 2]]) == {}


def test_slices_of_queries_share_a_graph(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, ids = rng.normal(size=(600, 8)), list(range(0, 6000, 10))
    whole = run(spark, ids, rows, 200)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 7)
    monkeypatch.setattr(hnsw, "SLICE_BLOCKS", 3)
    assert len(whole) == 300 and run(spark, ids, rows, 200) == whole
