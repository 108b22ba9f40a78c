"""Mixing against the SQL form and against plain arithmetic."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsfeat.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target string"


def rows_of(n):
    out = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else None if i % 17 == 0 else f"s{i % 5}"
        out.append((i, " ".join(["w"] * (i * 7 % 23)), "en", source, 0, "clash", "clash"))
    return out + [(None, "a b", None, "hot", 0, "", ""), (n, None, None, "é", 0, "", ""), (5, "x y", "", "s0", 0, "", ""),
                  (5, "x y", "", "s0", 0, "", "")]


def planned(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return mixing.mix_plan(df).select("doc_id", "source", "size", F.col("__mix").alias("m")).collect()


def test_targets_fill_up(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1]))
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:  # reshare the excess until no source is above its cap
        free = [s for s in sizes if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({**{s: 2 * sizes[s] for s in capped}, **want})


def test_plan_meets_targets_and_order(spark):
    got = planned(spark, rows_of(4000))
    assert len(got) == 4004
    by_source = {}
    for r in got:
        assert 0 <= r.m["taken"] <= 2 * r.m["size"]
        s = by_source.setdefault(r.source, [0, 0, r.m["target"], []])
        s[0] += r.m["taken"]
        s[1] += r.m["size"]
        s[3] += [(c["position"], c["words"]) for c in r.m["copies"]]
        assert s[2] == r.m["target"]
    for taken, size, target, copies in by_source.values():
        assert abs(taken - target) <= 0.5 + 1e-6 or size == 0
        assert all(0 <= p <= 1 for p, _ in copies)
    assert sum(s[0] for s in by_source.values()) == pytest.approx(1.5 * sum(s[1] for s in by_source.values()), abs=5)
    assert planned(spark, rows_of(4000)[::-1]) != [] and sorted(map(str, planned(spark, rows_of(4000)[::-1]))) == sorted(map(str, got))


@pytest.mark.parametrize("schedule", mixing.SCHEDULES + (((0.0, 2.0), (1.0, 2.0)),))
def test_position_inverts_the_integral(spark, schedule):
    shares = [i / 40 for i in range(41)]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.position(F.col("s"), schedule).alias("t"))

    def integral(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            x = min(max(t, t0), t1) - t0
            total += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return total
    for r in df.collect():
        assert integral(r.t) / integral(1.0) == pytest.approx(r.s, abs=1e-9)


def test_matches_sql(spark):
    documents = pd.DataFrame(rows_of(800)[:-2], columns=["doc_id", "text", "lang", "source", "n_chars", "size", "target"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    want = duckdb.connect().register("documents", documents).sql(mixing.SQL).fetchall()
    df = spark.createDataFrame(rows_of(800)[:-2], SCHEMA)
    got = mixing.mix_plan(df).select("doc_id", "__mix.size", "__mix.source_size", "__mix.target", "__mix.taken",
                                     F.round(F.try_element_at("__mix.copies", F.lit(1)).position, 9).alias("p")).collect()

    def norm(rows):
        return sorted([(-1 if r[0] is None else r[0], *r[1:3], round(r[3], 6), r[4], None if r[5] is None or math.isnan(r[5]) else round(r[5], 7)) for r in rows], key=str)
    assert norm(got) == norm(want)


def test_mix_repeats_whole_rows_in_order(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "s", 5, "", "") for i in range(30)], SCHEMA)
    out = mixing.mix(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == 45 and len(set(ids)) == 30 and ids[:30] != sorted(ids[:30])


def test_empty_and_null_only(spark):
    assert planned(spark, []) == []
    only = planned(spark, [(None, None, None, None, None, None, None)] * 2)
    assert [r.m["taken"] for r in only] == [0, 0]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
