import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CODER = bpe.load(PATH, public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=80))
def test_any_text_equals_the_library(text):
    assert CODER.encode(text) == PLAIN.encode_ordinary(text)
    assert CODER.decode(CODER.encode(text)) == text.encode("utf-8")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcthe rn's\n\x1c\x0b é²½٣ß日", max_size=300))
def test_words_equal_the_library(text):
    assert CODER.encode(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abthe rsSvl's\n\t\x1c é½٣日!.-1", max_size=200), st.integers(1, 9))
def test_texts_by_halves_equal_the_library(text, leaf):
    old, bpe.TEXT_LEAF = bpe.TEXT_LEAF, leaf
    try:
        assert "".join(CODER.matches(text)) == text and CODER.matches(text) == CODER.split(text)
        assert CODER.encode(text) == PLAIN.encode_ordinary(text)
    finally:
        bpe.TEXT_LEAF = old


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab r's\n é!1", max_size=20), min_size=3, max_size=3))
def test_joining_texts_is_a_monoid(parts):
    x, y, z = (CODER.split(t) for t in parts)
    assert CODER.join_matches(CODER.join_matches(x, y), z) == CODER.join_matches(x, CODER.join_matches(y, z)) == CODER.split("".join(parts))


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60), st.binary(min_size=1, max_size=60), st.binary(min_size=1, max_size=60))
def test_join_is_a_monoid(a, b, c):
    x, y, z = (bpe.merge(p, CODER.ranks) for p in (a, b, c))
    assert CODER.join(CODER.join(x, y), z) == CODER.join(x, CODER.join(y, z)) == bpe.merge(a + b + c, CODER.ranks)
    assert CODER.join([], x) == x == CODER.join(x, [])


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " the" * 20_000, "x1" * 9_000, "\U0001f600" * 4_000])
def test_very_long_pieces(text):
    assert CODER.encode(text) == PLAIN.encode_ordinary(text)


def test_both_merge_loops_agree():
    for text in ("thatiswhathesaid" * 9, "aaaaab" * 30, "éüß" * 40):
        heap = bpe.merge(text.encode(), CODER.ranks)
        small, bpe.SMALL = bpe.SMALL, 10**9
        try:
            assert bpe.merge(text.encode(), CODER.ranks) == heap
        finally:
            bpe.SMALL = small


def test_query_columns(spark):
    texts = ["", None, "Hello world, it's 2024!", "  a  b \n", "naïve ½ ²"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)] + [(2, texts[2], 9), (None, "x", 0)], "doc_id bigint, text string, n_tokens int")
    rows = bpe.encode_documents(docs).collect()
    assert len(rows) == 7
    for r in rows:
        if r.doc_id is not None:
            text = texts[r.doc_id] or ""
            ids = PLAIN.encode_ordinary(text)
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0)).collect() == []


def test_ids_decode_to_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    back = bpe.decode_ids(bpe.token_ids(docs)).select("doc_id", F.decode("data", "utf-8").alias("back"))
    joined = docs.join(back, "doc_id")
    assert joined.count() == docs.count() and joined.filter("back != text").count() == 0


def test_a_full_memo_is_replaced():
    small = bpe.TreeBpe(CODER.ranks, public_tokenizers.PATTERN, memo=5)
    text = " ".join(f"word{chr(97 + i % 26)}" * (1 + i % 3) for i in range(200))
    assert small.digest(text) == CODER.digest(text) and len(small.memo) <= 5
