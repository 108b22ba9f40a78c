"""Byte-level BPE encoding and decoding.

The ranks file is read on the driver and broadcast (a vocabulary has a fixed
size).  Each worker process builds an Aho-Corasick automaton over the reversed
tokens, bytes mapped to Latin-1 characters; one scan of a piece gives the
longest token at each position.  Encoding backtracks over these: a token is
taken if it is compatible with the one before, where two tokens are compatible
when the exact merges of their joined bytes give back just these two; answers
are memoised, so a piece takes linear time however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsfeat.llm.common import read, utf8

VOCABULARY = "byte_bpe_50k.tiktoken"
CACHED_PIECES = 150_000       # pieces a worker remembers before it starts anew
CACHED_BYTES = 32             # longer pieces are not remembered
BYTES_AT_ONCE = 4 << 20       # of ids that a worker holds together, one text more at most
CACHED_PAIRS = 300_000        # token pairs a worker remembers


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The defining merges: join the adjacent parts whose joined bytes have the
    lowest rank, leftmost first, until none has a rank.  For short pieces."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    none = len(ranks)
    joined = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while joined:
        rank = min(joined)
        if rank == none:
            break
        at = joined.index(rank)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del joined[at]
        if at:
            joined[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(joined):
            joined[at] = ranks.get(parts[at] + parts[at + 1], none)
    return parts


def read_ranks(ranks_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}


class Encoder:
    """Pieces to packed little-endian 32-bit ids."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = read_ranks(ranks_file)
        self.pattern = regex.compile(pattern)
        self.packed = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        # Only a token that its own bytes merge into can be part of a result.
        reached = [t for t in self.ranks if len(merged(t, self.ranks)) == 1]
        self.tokens = set(reached)
        self.longest = ahocorasick.Automaton()
        for t in reached:
            self.longest.add_word(t[::-1].decode("latin-1"), t)
        self.longest.make_automaton()
        self.shorter: dict[bytes, bytes | None] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces = _Pieces(self)
        self.decode = Decoder(self.ranks).decode

    def compatible(self, left: bytes, right: bytes) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = merged(left + right, self.ranks) == [left, right]
        return known

    def prefix(self, token: bytes) -> bytes | None:
        """The next shorter token that ``token`` starts with."""
        if token not in self.shorter:
            self.shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.tokens),
                                       None)
        return self.shorter[token]

    def split(self, piece: bytes) -> list[bytes]:
        """The tokens of one piece."""
        if piece in self.ranks:
            return [piece]
        size = len(piece)
        at: list[bytes | None] = [None] * size  # the longest token that starts at each position
        for end, token in self.longest.iter(piece[::-1].decode("latin-1")):
            if at[end] is None:  # of the tokens that end together the longest comes first
                at[end] = token
        at.reverse()
        dead = bytearray(size + 1)  # positions that no full encoding passes
        pairs = self.pairs
        taken: list[bytes] = []
        pos, token = 0, at[0]
        while pos < size:
            while token is not None:
                if not dead[pos + len(token)]:
                    if not taken:
                        break
                    known = pairs.get((taken[-1], token))
                    if known or known is None and self.compatible(taken[-1], token):
                        break
                token = self.prefix(token)
            if token is not None:
                taken.append(token)
                pos += len(token)
                token = at[pos] if pos < size else None
            elif taken:
                dead[pos] = 1
                last = taken.pop()
                pos -= len(last)
                token = self.prefix(last)
            else:
                raise ValueError("a byte has no token")
        return taken

    def encode(self, text: bytes) -> bytes:
        pieces = self.pattern.findall(text.decode("utf-8", "replace"))
        out = b"".join(map(self.pieces.__getitem__, pieces))
        if len(self.pieces) > CACHED_PIECES:
            self.pieces.clear()
        return out


class _Pieces(dict):
    """Packed ids of pieces, worked out on first use."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        ids = b"".join(map(self.encoder.packed.__getitem__, self.encoder.split(raw)))
        if len(raw) <= CACHED_BYTES:
            self[piece] = ids
        return ids


class Decoder:
    """Packed ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}

    def decode(self, ids: bytes) -> bytes:
        """A part of a long text at a time: an id is never held as a number for
        all of it."""
        numbers = np.frombuffer(ids, "<u4")
        return b"".join(b"".join(map(self.bytes_of.__getitem__, numbers[at:at + 65_536].tolist()))
                        for at in range(0, len(numbers), 65_536))


_MADE: dict[tuple, Encoder | Decoder] = {}  # of this worker process


def _decoder(ranks_file: bytes) -> Decoder:
    return Decoder(read_ranks(ranks_file))


def made(kind: Callable, *args):
    key = (kind, hashlib.sha256(repr(args).encode()).digest())
    if key not in _MADE:
        _MADE[key] = kind(*args)
    return _MADE[key]


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``, one row per input row, ``ids`` packed as
    little-endian unsigned 32-bit integers.

    No special tokens.  Null and empty texts have no ids; bytes that are no
    UTF-8 count as U+FFFD; repeated rows come back as often as they came; other
    columns are not read; an empty table gives no rows.
    """
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(Encoder, sent.value, pattern)
        for batch in batches:
            ids, size, begun = [], 0, 0
            for at, text in enumerate(batch.column(1), 1):
                ids.append(encoder.encode(text.as_py()))
                size += len(ids[-1])
                if size > BYTES_AT_ONCE or at == batch.num_rows:
                    counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begun, len(ids)), pa.array(counts),
                                                      pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
                    ids, size, begun = [], 0, at

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decoded(spark: SparkSession, ids: str, path: str) -> Column:
    """The bytes that a column of packed ids stands for (null: null)."""
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(made(_decoder, sent.value).decode, na_action="ignore")

    return run(F.col(ids))


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each text encoded and
    decoded again by one worker, text by text; only counts and digests leave it.
    Rows, nulls and other columns as for ``encode``."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(Encoder, sent.value, pattern)
        for batch in batches:
            counts, coded, decoded_ = [], [], []
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded_.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                                              pa.array(decoded_, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def q_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
