"""BPE against tiktoken itself, with exact round trips."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from newsfeat.llm import bpe

PATH = P.path(bpe.VOCABULARY)
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(1)
    pools = ["abcde ", "aA1 '\n\t", "éüñ漢字かな한국ไทย ", "  \x1c\x85​ ", "!?#=-_<|>", "the ing tion er an re "]
    out = ["", " ", "\n\n  \n", "<|endoftext|>", "I'll we're don'T", "İ\U0001f600\U0001f468‍\U0001f469", "a" * 3000,
           " " * 2000 + "x", "=" * 999, "ab" * 4000, "漢" * 1500]
    for _ in range(600):
        pool = rng.choice(pools) if rng.random() < 0.7 else "".join(pools)
        out.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 80))))
    out += ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (50, 300, 5000)]
    return out


def test_as_the_library_does(reference):
    with open(PATH, "rb") as f:
        ranks_file = f.read()
    encoder, decoder = bpe.Encoder(ranks_file, P.PATTERN), bpe._decoder(ranks_file)
    for text in hard_texts():
        packed = encoder.encode(text.encode())
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text), text[:60]
        assert decoder.decode(packed) == text.encode()


def test_query_digests(spark, reference):
    texts = [None, *hard_texts()[:60], "x"]
    rows = [(i if i else None, t, "clash", "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in bpe.digests(spark.createDataFrame(rows + rows[5:6], SCHEMA)).collect()}
    for i, t, _, _ in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_encode_and_decode_columns(spark, reference, monkeypatch):
    monkeypatch.setattr(bpe, "BYTES_AT_ONCE", 500)
    texts = [None, *hard_texts()[:80]]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)
    coded = bpe.encode(df, PATH)
    got = {r.doc_id: r for r in coded.withColumn("back", bpe.decoded(spark, "ids", PATH)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, bytes(got[i].ids), bytes(got[i].back)) == (len(ids) // 4, ids, (t or "").encode())


def test_invalid_bytes_and_empty_table(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert bpe.digests(df).first().decoded_sha256 == hashlib.sha256("a�b".encode()).hexdigest()
    assert bpe.digests(spark.createDataFrame([], SCHEMA)).count() == 0
