"""Conversation structure repair by a rank-convergence parallel Viterbi.

A conversation's rows, in order, are edited at least cost into an optional
system row and then user / assistant pairs.  The automaton has four states
(nothing yet, system, user, assistant), so the least cost of the rest of a
conversation is a vector of four numbers, and vectors that differ by a constant
lead to the same edits.

Rows are range-partitioned by (conversation, turn), so that one conversation may
lie in many partitions, and cut into parts of a bounded size.  A conversation
inside one part is repaired there.  For the others every part but the last first
runs backwards from a speculative cost vector; fix-up passes hand each part the
vector at the start of the next one and rerun it only until old and new vectors
differ by a constant.  Rows that never make vectors converge (rows that must be
deleted, rows of unknown roles) would need a pass per part: after ``FIX_UPS``
passes the four-by-four cost matrices of the parts are multiplied pairwise,
doubling the reach each round.  Then the stitched backward costs drive the trace
of the least audit, each part from the state in which the one before it ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import partitions, read
from newsfeat.session import written_table

PART_ROWS = 1024          # rows of a part at most
PART_BYTES = 4 << 20      # bytes of a part's texts, one row more at most
FIX_UPS = 3               # passes before matrices take over
PREFIX = 64               # characters of a text that range bounds hold
FAR = 1 << 40             # the cost of what can't be

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: b"user", ASSISTANT: b"assistant"}
AFTER_INSERT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
AFTER_KEEP = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
END = (0, 4, 2, 0)        # nothing left: done, or what has to be inserted
SPECULATIVE = (0, 0, 2, 0)  # the costs before any legal pair

_VISIBLE = re.compile(rb"[^\x20\x09-\x0D]")


# ------------------------------------------------------------------- recurrence
# A row's code: "x" must be deleted; else the initial of its role ("o": any
# other), in upper case if the text is truncated.
@lru_cache(maxsize=None)
def _moves(code: str, after: tuple) -> tuple:
    """What one row does, given the costs after it: the costs before it, and for
    each state the least edits (letters), the state they lead to and their cost."""
    kept = AFTER_KEEP.get(code.lower(), {})
    late = TRUNCATED if code.isupper() else 0
    options = []
    for state in range(4):
        own = [(DELETE + after[state], "D", state)]
        if code != "x":
            if state in kept:
                own.append((late + after[kept[state]], "K", kept[state]))
            turn = AFTER_INSERT[state]
            own.append((REROLE + late + after[turn], "R", turn))
        options.append(own)
    bare = [min(own)[0] for own in options]
    before = list(bare)
    for _ in range(3):
        before = [min(bare[q], INSERT + before[AFTER_INSERT[q]]) for q in range(4)]
    steps = []
    for state in range(4):
        edits, at = "", state
        while True:  # the smallest letter that stays on a cheapest way
            own = [o for o in options[at] if o[0] == before[at]]
            if INSERT + before[AFTER_INSERT[at]] == before[at]:
                own.append((before[at], "I", AFTER_INSERT[at]))
            _, letter, at = min(own, key=lambda o: o[1])
            edits += letter
            if letter != "I":
                break
        steps.append((edits, at, before[state] - after[at]))
    return tuple(before), tuple(steps)


@lru_cache(maxsize=None)
def _normal(vector: tuple) -> tuple[tuple, int]:
    least = min(vector)
    return tuple(min(v - least, FAR) for v in vector), least


def backward(code: str, after: tuple) -> list[tuple]:
    """The cost vectors after each row, less their least number each; the first
    entry is the vector before the first row."""
    vectors = [_normal(after)[0]]
    for c in reversed(code):
        vectors.append(_normal(_moves(c, vectors[-1])[0])[0])
    return vectors[::-1]


def converged(code: str, old: tuple, new: tuple) -> tuple:
    """The vector before the rows for a new vector after them; rerun only until
    it differs by a constant from the old one (then the start is the old one)."""
    a, b = _normal(old)[0], _normal(new)[0]
    for i in range(len(code) - 1, -1, -1):
        if a == b:
            return backward(code[:i + 1], a)[0]
        a, b = _normal(_moves(code[i], a)[0])[0], _normal(_moves(code[i], b)[0])[0]
    return b


def trace(code: str, vectors: list[tuple], state: int) -> tuple[list[str], int, int]:
    """The edits of each row from a state on, the cost and the last state."""
    edits, cost = [], 0
    for c, after in zip(code, vectors[1:]):
        letters, state, own = _moves(c, after)[1][state]
        edits.append(letters)
        cost += own
    return edits, cost, state


def finish(state: int) -> tuple[str, int, int]:
    """The inserts that end a conversation."""
    n = END[state] // INSERT
    return "I" * n, END[state], state if n == 0 else ASSISTANT


def matrix(code: str) -> tuple[int, ...]:
    """Costs from each state before the rows to each state after them, by rows."""
    columns = []
    for q in range(4):
        vector = tuple(0 if r == q else FAR for r in range(4))
        for _ in range(3):
            vector = tuple(min(vector[r], INSERT + vector[AFTER_INSERT[r]]) for r in range(4))
        total = 0
        for c in reversed(code):
            vector, least = _normal(_moves(c, vector)[0])
            total += least
        columns.append([min(v + total, FAR) for v in vector])
    return tuple(columns[q][r] for r in range(4) for q in range(4))


def times(a: list[int], b: list[int]) -> list[int]:
    """The min-plus product of two matrices."""
    return [min(min(a[4 * r + k] + b[4 * k + q] for k in range(4)), FAR) for r in range(4) for q in range(4)]


def initial(role: bytes) -> str:
    return role[:1].decode("latin-1")


def row_code(role: bytes, text: bytes, seen: set[bytes]) -> tuple[str, str, bytes]:
    """(fault, code, digest): the first fault of a row, '' for none."""
    if not _VISIBLE.search(text):
        return "blank", "x", b""
    digest = hashlib.blake2b(role + b"\0" + text, digest_size=16).digest()
    if digest in seen:
        return "duplicate", "x", b""
    seen.add(digest)
    code = initial(role) if initial(role) in ("s", "u", "a") else "o"
    if text.rstrip(b" \t\n\x0b\x0c\r")[-1:] not in (b".", b"!", b"?"):
        return "truncated", code.upper(), digest
    return "", code, digest


def edited(edits: list[str], roles: list[bytes], texts: list[bytes], state: int) -> tuple[list[bytes], list[bytes]]:
    """Roles and texts of the repaired rows, from the state before them on."""
    out_roles, out_texts = [], []
    for i, letters in enumerate(edits):
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                out_roles.append(roles[i])
                out_texts.append(texts[i])
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[initial(roles[i])]
            else:
                state = AFTER_INSERT[state]
                out_roles.append(ROLE[state])
                out_texts.append(texts[i] if letter == "R" else b"")
    return out_roles, out_texts


# ------------------------------------------------------------------------ parts
_INFO = [("n", "long"), ("min_turn", "long"), ("max_turn", "long"), ("turns", "long"), ("first_turn", "long"),
         ("last_turn", "long"), ("first_initial", "string"), ("last_initial", "string"), ("blank", "long"),
         ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"), ("audit", "string"),
         ("code", "string"), ("roles", "array<binary>"), ("texts", "array<binary>"), ("digests", "array<binary>")]
_PART = [("pid", "long"), ("seq", "long"), ("conv_id", "long"), ("edge", "boolean"), ("starts", "boolean"),
         ("ends", "boolean")] + _INFO
_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<binary>": pa.list_(pa.binary())}


def _ddl(columns: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in columns)


def _batches(records: Iterator[dict], columns: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches bounded by rows and by the bytes of their texts."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += 200 + sum(map(len, record.get("texts") or ()))
        if size > PART_BYTES or len(held) >= 2000:
            yield _arrow(held, columns)
            held, size = [], 0
    if held:
        yield _arrow(held, columns)


def _arrow(held: list[dict], columns: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], _ARROW[t]) for n, t in columns],
                                      names=[n for n, _ in columns])


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def part_of(rows: list[tuple]) -> dict:
    """The record of some rows (turn, role, text) of one conversation."""
    seen: set[bytes] = set()
    coded = [row_code(role, text, seen) for _, role, text in rows]
    faults = [c[0] for c in coded]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [initial(role) for _, role, _ in rows]
    return {
        "n": len(rows), "min_turn": min(turns, default=None), "max_turn": max(turns, default=None),
        "turns": len(set(turns)), "first_turn": rows[0][0] if rows else None, "last_turn": rows[-1][0] if rows else None,
        "first_initial": initials[0] if rows else None, "last_initial": initials[-1] if rows else None,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(not _legal(a, b) for a, b in zip(initials, initials[1:])),
        "code": "".join(c[1] for c in coded), "roles": [r for _, r, _ in rows], "texts": [t for _, _, t in rows],
        "digests": [c[2] for c in coded]}


def repaired(record: dict, after: tuple, state: int, last: bool) -> dict:
    """The record with its edits: audit, cost and the rows they give."""
    code = record["code"]
    edits, cost, end = trace(code, backward(code, after), state)
    roles, texts = edited(edits, record["roles"], record["texts"], state)
    audit = "".join(edits)
    if last:
        more, own, _ = finish(end)
        for _ in more:
            end = AFTER_INSERT[end]
            roles.append(ROLE[end])
            texts.append(b"")
        audit, cost = audit + more, cost + own
    return record | {"audit": audit, "cost": cost, "roles": roles, "texts": texts, "digests": None}


def _cut(batches: Iterator[pa.RecordBatch], part_rows: int) -> Iterator[dict]:
    """Parts of the sorted rows of a partition.

    A conversation that lies inside the partition and in one part is repaired at
    once.  The first and the last one of a partition, and longer ones, give
    ``edge`` parts as they are.  A conversation of which no row is present gives
    a record without rows and with ``seq`` -1.
    """
    place = {"pid": TaskContext.get().partitionId()}
    seq, nth, part, size, conv, rows = 0, -1, 0, 0, None, []

    def closed(ends: bool, last: bool) -> dict | None:
        nonlocal seq, part, size, rows
        edge = not ends or last or part > 0 or nth == 0
        held, rows, size = rows, [], 0
        if not held and part > 0:
            return None
        record = part_of(held)
        if not held:
            return place | record | {"seq": -1, "conv_id": conv, "edge": edge, "cost": 0, "audit": ""}
        if not edge:
            record = repaired(record, END, NONE, True)
        record |= place | {"seq": seq, "conv_id": conv, "edge": edge, "starts": part == 0, "ends": ends}
        seq, part = seq + 1, part + 1
        return record

    for batch in batches:
        for own, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns)):
            if nth < 0 or own != conv:
                if nth >= 0 and (record := closed(True, False)):
                    yield record
                conv, nth, part = own, nth + 1, 0
            if gone:
                continue
            if len(rows) >= part_rows or size > PART_BYTES:
                yield closed(False, False)
            rows.append((turn, role, text))
            size += len(text) + len(role)
    if nth >= 0 and (record := closed(True, True)):
        yield record


def parts_of(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None,
             part_rows: int) -> DataFrame:
    """The part table, written.  Ties of a turn are ordered by role, the first
    characters of the text and a hash of it; equal rows in any order."""
    space = F.lit(" ")
    narrow = rows.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        (F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)).alias("gone"),
    ).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", F.substring("text", 1, PREFIX), F.xxhash64("text"), "tie"]
    placed = (narrow.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
              .select("conv", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "gone"))
    return written_table(placed.mapInArrow(lambda b: _batches(_cut(b, part_rows), _PART), _ddl(_PART)), "parts")


# ------------------------------------------------------ parts that lie side by side
def _numbered(parts: DataFrame) -> DataFrame:
    """The edge parts with ``idx``, consecutive over the parts of a conversation,
    and whether each is its first and its last.  Only one row a partition, the
    conversations at its two ends, goes to the driver."""
    edge = parts.where("edge AND seq >= 0")
    place = F.struct("seq", "conv_id")
    ends = edge.groupBy("pid").agg(F.min(place).alias("a"), F.max(place).alias("b")).orderBy("pid").collect()
    rows, offset = [], 0
    for i, r in enumerate(ends):
        rows.append((r.pid, offset - r.a.seq, r.a.seq, r.b.seq, i > 0 and ends[i - 1].b.conv_id == r.a.conv_id,
                     i + 1 < len(ends) and ends[i + 1].a.conv_id == r.b.conv_id))
        offset += r.b.seq - r.a.seq + 1
    table = parts.sparkSession.createDataFrame(
        rows, "pid long, offset long, low long, high long, joins boolean, goes_on boolean")
    return (edge.join(F.broadcast(table), "pid").withColumn("idx", F.col("seq") + F.col("offset"))
            .withColumn("first", F.expr("starts AND NOT (joins AND seq = low)"))
            .withColumn("last", F.expr("ends AND NOT (goes_on AND seq = high)"))
            .drop("offset", "low", "high", "joins", "goes_on"))


def _mapped(df: DataFrame, step: Callable[[dict], dict], columns: list[tuple[str, str]]) -> DataFrame:
    """Rows to rows by a plain function."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches((step(r) for b in batches for r in b.to_pylist()), columns)

    return df.mapInArrow(run, _ddl(columns))


_HEAD = [("idx", "long"), ("conv_id", "long"), ("first", "boolean"), ("last", "boolean"), ("first_turn", "long"),
         ("last_turn", "long"), ("first_initial", "string"), ("last_initial", "string"), ("duplicate", "long"),
         ("truncated", "long"), ("code", "string")]
_STATE = [("idx", "long"), ("conv_id", "long"), ("last", "boolean"), ("code", "string"), ("after", "array<long>"),
          ("before", "array<long>")]
_ARROW["array<long>"] = pa.list_(pa.int64())


def _heads(edge: DataFrame) -> DataFrame:
    """A narrow row a part, its code without rows that an earlier part holds too."""
    marks = (edge.where("NOT (first AND last)").select("idx", "conv_id", F.posexplode("digests").alias("pos", "digest"))
             .where("length(digest) > 0"))
    twice = (marks.groupBy("conv_id", "digest").agg(F.min("idx").alias("least"), F.max("idx").alias("most"))
             .where("least < most").withColumnRenamed("conv_id", "conv").withColumnRenamed("digest", "d"))
    later = (marks.join(twice, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("d")))
             .where("idx > least").groupBy("idx").agg(F.collect_set("pos").alias("later")))

    def recode(r: dict) -> dict:
        code = list(r["code"])
        for i in r["later"] or ():
            r["duplicate"] += 1
            r["truncated"] -= code[i].isupper()
            code[i] = "x"
        return r | {"code": "".join(code)}

    names = [n for n, _ in _HEAD]
    return written_table(_mapped(edge.select(*names).join(later, "idx", "left"), recode, _HEAD), "part-heads")


def _with_costs(heads: DataFrame, longest: int, fix_ups: int) -> DataFrame:
    """``(idx, conv_id, last, code, after, before)``: the normalised cost vectors
    after and before each part."""
    def speculate(r: dict) -> dict:
        after = END if r["last"] else SPECULATIVE
        return r | {"after": after, "before": backward(r["code"], after)[0]}

    def rerun(r: dict) -> dict:
        old, new = tuple(r["after"]), tuple(r["new"])
        return r if old == new else r | {"after": new, "before": converged(r["code"], old, new)}

    state = written_table(_mapped(heads.select("idx", "conv_id", "last", "code"), speculate, _STATE), "speculative")
    for _ in range(min(fix_ups, longest)):
        following = state.select((F.col("idx") - 1).alias("idx"), F.col("before").alias("new"))
        met = state.join(following, "idx", "left").withColumn("new", F.when(F.col("last"), F.col("after")).otherwise(F.col("new")))
        if met.where("new != after").isEmpty():
            return state
        state = written_table(_mapped(met, rerun, _STATE), "fix-up")
    # Vectors that don't converge: products of cost matrices, a power of two of parts a round.
    m_columns = [("idx", "long"), ("conv_id", "long"), ("m", "array<long>")]
    products = written_table(_mapped(state, lambda r: r | {"m": matrix(r["code"])}, m_columns), "matrices")
    reach = 1
    while reach < longest:
        ahead = products.select((F.col("idx") - reach).alias("idx"), F.col("conv_id").alias("c"), F.col("m").alias("more"))
        met = products.join(ahead, "idx", "left").withColumn("more", F.when(F.col("c").eqNullSafe(F.col("conv_id")), F.col("more")))
        products = written_table(_mapped(met, lambda r: r | {"m": times(r["m"], r["more"]) if r["more"] else r["m"]},
                                         m_columns), "products")
        reach *= 2

    def stitch(r: dict) -> dict:
        before = [min(r["m"][4 * q + k] + END[k] for k in range(4)) for q in range(4)]
        return {"idx": r["idx"], "m": _normal(tuple(before))[0]}

    before = _mapped(products, stitch, [("idx", "long"), ("m", "array<long>")])
    stitched = (state.drop("after", "before").join(before.withColumnRenamed("m", "before"), "idx")
                .join(before.select((F.col("idx") - 1).alias("idx"), F.col("m").alias("after")), "idx", "left")
                .withColumn("after", F.when(F.col("last"), F.array(*[F.lit(x).cast("long") for x in END]))
                            .otherwise(F.col("after"))))
    return written_table(stitched.select(*[n for n, _ in _STATE]), "stitched-costs")


def _with_states(state: DataFrame, longest: int) -> DataFrame:
    """``(idx, state)``: the state before each part.  A part maps each of the four
    states to the one that its trace ends in; maps are composed, a power of two
    of parts a round."""
    columns = [("idx", "long"), ("conv_id", "long"), ("ends", "array<long>")]

    def ends(r: dict) -> dict:
        vectors = backward(r["code"], tuple(r["after"]))
        return r | {"ends": [trace(r["code"], vectors, q)[2] for q in range(4)]}

    maps = written_table(_mapped(state, ends, columns), "part-maps")
    reach = 1
    while reach < longest:
        back = maps.select((F.col("idx") + reach).alias("idx"), F.col("conv_id").alias("c"), F.col("ends").alias("b"))
        composed = F.transform("b", lambda q: F.get(F.col("ends"), q.cast("int")))
        maps = written_table(maps.join(back, "idx", "left").withColumn("ends", F.when(
            F.col("c").eqNullSafe(F.col("conv_id")) & F.col("b").isNotNull(), composed).otherwise(F.col("ends")))
            .select(*[n for n, _ in columns]), "composed-maps")
        reach *= 2
    return maps.select((F.col("idx") + 1).alias("idx"), F.get("ends", F.lit(NONE)).alias("state"))


_OUT = [("conv_id", "long"), ("part", "long"), ("whole", "boolean"), ("n", "long"), ("min_turn", "long"),
        ("max_turn", "long"), ("turns", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"),
        ("illegal", "long"), ("cost", "long"), ("audit", "string"), ("roles", "array<binary>"),
        ("texts", "array<binary>")]


def _stitched(parts: DataFrame, fix_ups: int) -> DataFrame:
    edge = _numbered(parts)
    heads = _heads(edge)
    longest = heads.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    state = _with_costs(heads, longest, fix_ups)
    starts = _with_states(state, longest)
    previous = heads.where("NOT last").select((F.col("idx") + 1).alias("idx"), F.col("last_turn").alias("prev_turn"),
                                              F.col("last_initial").alias("prev_initial"))
    met = (edge.drop("duplicate", "truncated", "code", "digests")
           .join(heads.select("idx", "duplicate", "truncated", "code"), "idx")
           .join(state.select("idx", "after"), "idx").join(starts, "idx", "left").join(previous, "idx", "left"))

    def step(r: dict) -> dict:
        out = repaired(r, tuple(r["after"]), NONE if r["first"] else r["state"], r["last"])
        if not r["first"]:
            out["turns"] -= r["prev_turn"] is not None and r["prev_turn"] == r["first_turn"]
            out["illegal"] += not _legal(r["prev_initial"], r["first_initial"])
        return out | {"part": r["idx"], "whole": r["first"] and r["last"]}

    return _mapped(met, step, _OUT)


# --------------------------------------------------------------------- operator
def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", gone_col: str | None = None, part_rows: int = PART_ROWS,
           fix_ups: int = FIX_UPS) -> DataFrame:
    """One row per part of a conversation: ``(conv_id, part, whole, n, min_turn,
    max_turn, turns, blank, duplicate, truncated, illegal, cost, audit, roles,
    texts)``; ``roles`` and ``texts`` are the repaired rows, ``part`` orders the
    parts of a conversation, ``whole`` says that there is one only, and the counts
    of all parts add up.

    Rows are taken by turn, nulls first, ties by role, text beginning and text
    hash.  A null role or text counts as one space, a null conversation id is an
    id like others.  Rows where ``gone_col`` is true only name their
    conversation, which gets a part without rows if nothing else is there.
    Repeated rows count as duplicates; an empty table gives no rows; other
    columns are not read.
    """
    parts = parts_of(rows, conv_col, turn_col, role_col, text_col, gone_col, part_rows)
    names = [n for n, _ in _OUT]
    inside = parts.where("NOT edge").withColumn("part", F.lit(0).cast("long")).withColumn("whole", F.lit(True))
    empty = (parts.where("edge AND seq < 0").join(  # at most two a partition
        parts.where("edge AND seq >= 0").select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
        .join(parts.where("NOT edge").select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti")
        .dropDuplicates(["conv_id"]).withColumn("part", F.lit(0).cast("long")).withColumn("whole", F.lit(True)))
    out = inside.select(*names).unionByName(empty.select(*names)).unionByName(_stitched(parts, fix_ups))
    as_text = "array<string>"
    return out.withColumn("roles", F.col("roles").cast(as_text)).withColumn("texts", F.col("texts").cast(as_text))


def summaries(parts: DataFrame) -> DataFrame:
    """One row per conversation: its counts, audit and the sha256 of its repaired
    ``role:text`` lines.  A conversation of several parts is hashed by reading
    them in order, one part in memory at a time."""
    def gaps(turns: Column, least: Column, most: Column) -> Column:
        return F.coalesce(most - least + 1 - turns, F.lit(0)).cast("long")

    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = parts.where("whole").select(
        "conv_id", gaps(F.col("turns"), F.col("min_turn"), F.col("max_turn")).alias("gaps"), *counts, "audit",
        F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    several = parts.where("NOT whole")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [("conv_id", "long"), ("audit", "string"), ("repaired_sha256", "string")]

        def records() -> Iterator[dict]:
            now, sha, audit, begun = None, None, [], False
            for batch in batches:
                for r in batch.to_pylist():
                    if sha is None or r["conv_id"] != now:
                        if sha is not None:
                            yield {"conv_id": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}
                        now, sha, audit, begun = r["conv_id"], hashlib.sha256(), [], False
                    audit.append(r["audit"])
                    for line in r["lines"]:
                        sha.update(b"\n" + line if begun else line)
                        begun = True
            if sha is not None:
                yield {"conv_id": now, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

        return _batches(records(), columns)

    rows = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t).cast("binary")).alias("lines")
    hashed = (several.select("conv_id", "part", "audit", rows)
              .repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
              .select("conv_id", "audit", "lines").mapInArrow(digest, "conv_id long, audit string, repaired_sha256 string"))
    totals = several.groupBy(F.col("conv_id").alias("c")).agg(
        gaps(F.sum("turns"), F.min("min_turn"), F.max("max_turn")).alias("gaps"),
        *[F.sum(c).cast("long").alias(c) for c in counts])
    return whole.unionByName(hashed.join(totals, F.col("conv_id").eqNullSafe(F.col("c"))).select(*whole.columns))


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: the rows with the faults that the
    crc32 of ``conv_id:turn`` modulo 20 picks (nulls count as one space)."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    kinds = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return kinds.select(
        "conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("k") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))).alias("nth"),
    ).drop("nth")


def q_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(repair(damaged(read(spark, sf_dir, "conversations")), gone_col="gone"))
