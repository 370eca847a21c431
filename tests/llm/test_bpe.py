"""Encoding with a public vocabulary against its public library."""

from __future__ import annotations

import random

import pytest

from sentrymill.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [
    None, "", " ", "\n\n", "Hello, world's 3rd  test.", "don't  we'll they've I'M it's", "<|endoftext|> is text", "日本語テキスト 한국어 हिन्दी", "👩🏽‍💻🏴‍☠️ café",
    "a" * 5000, "ab" * 3000, "=" * 999, " " * 500, "\x1c\x85\xa0​", "x1y2z3" * 400,
]


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.VOCABULARY, "rb") as f:
        return bpe.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts_match_the_library(ranks, library):
    mine = bpe.BytePairEncoder(ranks)
    for t in TEXTS:
        assert mine.encode(t) == library.encode_ordinary(t or ""), t


def test_random_texts_match_and_decode(ranks, library):
    mine, rng = bpe.BytePairEncoder(ranks), random.Random(4)
    back = {i: b for b, i in ranks.items()}
    for _ in range(1500):
        t = "".join(rng.choice("ab cde\n\t'sé中😀12½ \x1f") for _ in range(rng.randrange(80)))
        ids = mine.encode(t)
        assert ids == library.encode_ordinary(t)
        assert b"".join(back[i] for i in ids).decode() == t


def test_scan_and_heap_give_the_same(ranks):
    mine, rng = bpe.BytePairEncoder(ranks), random.Random(6)
    for _ in range(300):
        w = bytes(rng.choice(b"abcdetino=\xc3\xa9") for _ in range(rng.randrange(2, 200)))
        assert mine._scanned(w) == mine._heaped(w)


def test_rows_keep_their_keys_and_order_of_ids(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encoded(df, "doc_id", "text").collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert bpe.encoded(df.limit(0), "doc_id", "text").count() == 0
    assert bpe.encoded(df, "doc_id", "text").dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
