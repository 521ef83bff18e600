import hashlib
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, documents, plain, sentence
from wayfare.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
CODEC = bpe.Codec.of(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_perfect_hash_is_minimal_and_exact():
    h = CODEC.whole
    assert len(h.slots) == len(RANKS) and sorted(h.values) == sorted(RANKS.values())
    assert all(h.get(k) == v for k, v in list(RANKS.items())[::7])
    assert h.get(b"not a token at all") is None and h.get(b"") is None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_runs():
    for text in ("a" * 5000, " " * 3000 + "b", "é" * 999, "\x1c\x1d \x85 x", "<|endoftext|>"):
        assert CODEC.encode(text) == LIBRARY.encode_ordinary(text)


def test_table(spark):
    rows = AWKWARD + [(100 + i, sentence(50, i), "en", "a") for i in range(20)]
    docs = documents(spark, rows)
    for memo in (1, bpe.MEMO):
        got = plain(bpe.encode_digests(docs, PATH, public_tokenizers.PATTERN, memo=memo))
        want = []
        for d, t, *_ in rows:
            ids = LIBRARY.encode_ordinary(t or "")
            want.append((d, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_round_trip(spark):
    docs = documents(spark, AWKWARD)
    back = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert plain(back.selectExpr("doc_id", "decode(text, 'UTF-8') AS text")) == plain(docs.selectExpr("doc_id", "coalesce(text, '') AS text"))


def test_unknown_id_raises():
    with pytest.raises(ValueError):
        CODEC.decode([len(RANKS) + 5])


def test_empty_table(spark):
    assert bpe.encode_digests(documents(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
