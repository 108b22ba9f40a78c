"""Ward trees against a plain loop over all pairs."""

import random

import numpy as np
import pytest

from newsfeat.operators import hierarchy as hi

SCHEMA = "id string, feature string, w double"


def plain_ward(x):
    """R's ward.D: the least distance merges, Ward's update on plain distances."""
    d = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(len(x)) for j in range(i)}
    d |= {(j, i): v for (i, j), v in d.items()}
    size, live, out = {i: 1 for i in range(len(x))}, set(range(len(x))), []
    while len(live) > 1:
        h, a, b = min((d[i, j], i, j) for i in live for j in live if i < j)
        new = len(x) + len(out)
        live -= {a, b}
        for k in live:
            t = size[a] + size[b] + size[k]
            d[k, new] = d[new, k] = ((size[a] + size[k]) * d[a, k] + (size[b] + size[k]) * d[b, k] - size[k] * h) / t
        live.add(new)
        size[new] = size[a] + size[b]
        out.append((a, b, h, size[new]))
    return out


def entries(n, width, seed=3):
    rng = random.Random(seed)
    return [(f"t{i:03}", f"d{j}", rng.uniform(-2, 2)) for i in range(n) for j in rng.sample(range(width), max(1, width // 3))]


def dense(rows):
    names, columns = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(names), len(columns)))
    for t, f, w in rows:
        x[names.index(t), columns.index(f)] += w or 0
    return names, x


def test_tree_is_plain_ward_when_every_row_is_a_feature(spark):
    rows = entries(50, 12) + [("t000", "d1", 0.5), ("zero", "d0", 0.0), ("nulls", "d1", None), ("nulls", "d2", 1.0)]
    merges, members = hi.ward_tree(spark.createDataFrame(rows + [(None, "d0", 1.0)], SCHEMA))
    names, x = dense(rows)
    assert [r.id for r in members.orderBy("node").collect()] == names
    got = merges.orderBy("step").collect()
    want = plain_ward(x)
    assert [(r.left, r.right, r.size) for r in got] == [(a, b, s) for a, b, _, s in want]
    assert np.allclose([r.height for r in got], [h for _, _, h, _ in want])
    assert got[-1].within == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_ward_on_squares_merges_by_the_rise_of_the_within_sum():
    x = np.random.default_rng(1).normal(size=(30, 4))
    merges, label = hi.ward(hi._squared(x, np.ones(30)), np.ones(30), 3)
    parts = {i: [i] for i in range(30)}

    def within(at):
        return ((x[at] - x[at].mean(0)) ** 2).sum()
    for s, (a, b, height) in enumerate(merges):
        parts[30 + s] = parts[a] + parts[b]
        assert height / 2 == pytest.approx(within(parts[30 + s]) - within(parts[a]) - within(parts[b]))
    assert len(merges) == 27 and set(label) == {0, 1, 2}


def test_groups_survive_the_reduce_over_many_blocks(spark):
    rng = random.Random(8)
    rows = [(f"t{i}", f"d{i % 6}-{j}", 1 + rng.uniform(-.1, .1)) for i in range(600) for j in range(5)]
    merges, members = hi.ward_tree(spark.createDataFrame(rows, SCHEMA), features=12, dims=64)
    node = {r.id: r.node for r in members.collect()}
    assert len(node) == 600 and 6 <= len(set(node.values())) <= 12
    assert all(len({i % 6 for i in range(600) if node[f"t{i}"] == k}) == 1 for k in set(node.values()))
    got = merges.orderBy("step").collect()
    assert len(got) == len(set(node.values())) - 1 and got[-1].size == 600
    _, x = dense(rows)
    assert got[-1].within == pytest.approx(((x - x.mean(0)) ** 2).sum())
    held = {k: {k} for k in set(node.values())}
    for i, r in enumerate(got):
        held[len(set(node.values())) + i] = held[r.left] | held[r.right]
    top = [held[len(set(node.values())) + i] for i in range(len(got) - 5)]  # six clusters are left
    group = {node[f"t{i}"]: i % 6 for i in range(600)}
    assert all(len({group[k] for k in s}) == 1 for s in top)


def test_one_row_and_none(spark):
    for rows in ([], [("a", "d", 1.0)]):
        merges, members = hi.ward_tree(spark.createDataFrame(rows, SCHEMA))
        assert merges.count() == 0 and members.count() == len(rows)
