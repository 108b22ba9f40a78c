"""Conversation repair against brute force: plain sequential search over edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from newsfeat.llm import conversations as C
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, part string, whole int"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text, kind == 0)] * (2 if kind == 3 else 1)
    return out


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen
                      else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return faults


def plain_edits(rows, faults):
    """Uniform-cost search over (row, role before, ended) by (cost, audit): no
    vectors, no backward pass."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, role, out = heapq.heappop(heap)
        if i == len(rows) and role in ("", "a"):
            return cost, audit, out
        if (i, role) in done:
            continue
        done.add((i, role))

        def step(more, letter, j, new, line=None):
            if line is None or (role + new) in ("s", "u", "su", "ua", "au"):
                heapq.heappush(heap, (cost + more, audit + letter, j, role if line is None else new,
                                      out if line is None else out + (line,)))
        for new, name in (("u", "user"), ("a", "assistant")):
            step(2, "I", i, new, f"{name}:")
        if i < len(rows):
            _, own, text = rows[i]
            step(3, "D", i + 1, "")
            if faults[i] not in ("blank", "duplicate"):
                late = faults[i] == "truncated"
                if own[:1] in ("s", "u", "a"):
                    step(late, "K", i + 1, own[0], f"{own}:{text}")
                for new, name in (("u", "user"), ("a", "assistant")):
                    step(2 + late, "R", i + 1, new, f"{name}:{text}")
    raise AssertionError


def plain(rows):
    """Expected summaries of (conv, turn, role, text, gone)."""
    groups = defaultdict(list)
    for conv, turn, role, text, gone in rows:
        groups[conv]
        if not gone:
            groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = plain_faults(own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = plain_edits(own, faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


def have(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0]))


def chatter(rng, conv, n, kinds="suaxo"):
    texts = ["Yes.", "No", "", " \t", "Why?", "Go!\n", "so ", "1.", "2.", "3.", "4?", "5!"]
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "o": None}
    return [(conv, rng.choice([None, i, i, i, i // 2 * 3]), names[rng.choice(kinds)],
             rng.choice(texts + [None] + [f"{rng.random()}."] * 12), rng.random() < 0.05) for i in range(n)]


def test_one_part_equals_uniform_cost_search():
    rng = random.Random(1)
    for _ in range(1500):
        rows = [(t, r or " ", x or " ") for _, t, r, x, _ in chatter(rng, 0, rng.randint(0, 9))]
        rows = [(t, r.encode(), x.encode()) for t, r, x in rows]
        record = C.repaired(C.part_of(rows), C.END, C.NONE, True)
        want = plain_edits(*(lambda p: (p, plain_faults(p)))([(t, r.decode(), x.decode()) for t, r, x in rows]))
        assert (record["cost"], record["audit"]) == want[:2]
        assert tuple(f"{r.decode()}:{t.decode()}" for r, t in zip(record["roles"], record["texts"])) == want[2]


@pytest.mark.parametrize("part_rows,fix_ups", [(1000, 3), (3, 3), (2, 0), (4, 50)])
def test_parts_equal_brute_force(spark, part_rows, fix_ups):
    rng = random.Random(part_rows)
    rows = [r for c in range(60) for r in chatter(rng, c if c else None, rng.randint(1, 12))]
    rows += chatter(rng, 7_000_000_000, 150) + chatter(rng, -5, 90, "xo") + chatter(rng, 2**62, 80, "u")
    rows += [(500, None, "user", "same", False)] * 70 + [(501, i, "user", "Same.", False) for i in range(60)]
    rows += [(502, 1, "user", "gone", True), (503, None, None, None, False)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = C.repair(df, gone_col="gone", part_rows=part_rows, fix_ups=fix_ups)
    assert have(C.summaries(out)) == plain(rows)


def test_vectors_converge_or_are_rerun():
    rng = random.Random(3)
    for _ in range(300):
        code = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randint(0, 30)))
        for old in (C.SPECULATIVE, (0, 4, 2, 0), (1, 0, 0, 2)):
            assert C.converged(code, old, C.END) == C.backward(code, C.END)[0]
        m = C.matrix(code)
        by_matrix = tuple(min(m[4 * q + k] + C.END[k] for k in range(4)) for q in range(4))
        assert C._normal(by_matrix)[0] == C.backward(code, C.END)[0]


def test_long_texts_empty_table_and_damage(spark):
    long = "word " * 400_000
    rows = [(1, i, ("user", "assistant")[i % 2], f"{long}{i}.") for i in range(6)] + [(None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = have(C.summaries(C.repair(C.damaged(df), gone_col="gone")))
    assert got == plain(plain_damage(rows))
    empty = C.repair(C.damaged(df.limit(0)), gone_col="gone")
    assert empty.collect() == [] and C.summaries(empty).collect() == []


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert have(C.q_conversations(spark, SF_SMALL)) == plain(plain_damage(rows))
