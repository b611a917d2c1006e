import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from helpers import ODD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from vspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
with open(PATH, "rb") as f:
    RANKS = bpe.read_ranks(f.read())
TRUTH = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = bpe.ByteBPE(RANKS, P.PATTERN, text_leaf=7, piece_leaf=3, cache=50)
FULL = bpe.ByteBPE(RANKS, P.PATTERN)


def expected(text):
    return np.array(TRUTH.encode_ordinary(text), "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_like_the_library(text):
    ids = SMALL.encode(text)
    assert ids == expected(text) == FULL.encode(text) and SMALL.decode(ids) == text.encode()


def test_mixed_texts_in_small_leaves():
    rng = random.Random(0)
    parts = ["a", "'s", "'", "re", "ll", " ", "  ", "\n", "é", "1", "23", "!", "the", "日", "🙂", "_", "ing", "tion", "\t", "...", "'ve"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert SMALL.encode(text) == expected(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, "é" * 9_000, " " * 20_000, "1234567890" * 2_000, "日本" * 5_000, "the" * 7_000, "word " * 30_000])
def test_long_pieces(text):
    assert FULL.encode(text) == expected(text)


def test_any_bytes_by_joins():
    rng = random.Random(1)
    for _ in range(1000):
        data = bytes(rng.choice(b"abcdeinortst\xc3\xa9 ") for _ in range(rng.randint(1, 60)))
        assert SMALL.reduce(data) == FULL.merge(data)


def test_tables(spark):
    docs = documents(spark, ODD + [(9, "Hello, world! <|endoftext|>", "en", "s")], extra=True)
    got = {r.doc_id: r for r in bpe.token_digests(docs, PATH, P.PATTERN).collect()}
    ids = expected("Hello, world! <|endoftext|>")
    assert got[9].n_tokens == len(ids) // 4 and got[9].ids_sha256 == hashlib.sha256(ids).hexdigest() and got[9].decoded_sha256 == hashlib.sha256(b"Hello, world! <|endoftext|>").hexdigest()
    assert got[1].n_tokens == 0 and len(got) == len({r[0] for r in ODD}) + 1
    back = bpe.decode_ids(bpe.encode_texts(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.token_digests(docs.filter("false"), PATH, P.PATTERN).collect() == []
