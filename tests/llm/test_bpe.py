import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import bpe

P = pytest.importorskip("public_tokenizers")
ENCODER = bpe.Encoder(bpe.load_ranks(bpe.default_vocabulary()))
PUBLIC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


def ids(texts):
    return bpe.BatchEncoder(ENCODER).ids(texts).to_pylist()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    slots = bpe.PerfectHash(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert bpe.PerfectHash([b"only"]).slots([b"only"]).tolist() == [0]
    with pytest.raises(ValueError):
        bpe.PerfectHash([b"a", b"a"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(), max_size=4))
def test_same_as_public_encoder(texts):
    assert ids(texts) == [PUBLIC.encode_ordinary(t) for t in texts]


def test_every_character_between_others():
    texts = [f"a {chr(c)}{chr(c)} 1{chr(c)}  b" for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    assert ids(texts) == PUBLIC.encode_ordinary_batch(texts)


def test_long_words_special_strings_and_nothing():
    rng = random.Random(0)
    texts = ["".join(rng.choices("abcdefgh", k=30_000)), " " * 50_000 + "x", "<|endoftext|>", "\r\n \x85\x1c x", "é" * 9999]
    assert ids(texts) == [PUBLIC.encode_ordinary(t) for t in texts]
    assert ids([None, "", "a"]) == [[], [], PUBLIC.encode_ordinary("a")]
    assert ids([]) == []


def test_lengths_and_memo(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    e = bpe.BatchEncoder(ENCODER)
    for t in ["one two three four", "five six", "", "one two"]:
        assert e.lengths([t, None]).tolist() == [len(PUBLIC.encode_ordinary(t)), 0]


def test_table(spark):
    df = spark.createDataFrame([(1, "Hello world", [0]), (2, None, None), (3, "", None), (1, "Hello world", [0])], "doc_id long, text string, ids array<int>")
    got = sorted(map(tuple, bpe.encode(df).collect()))
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert bpe.encode(df.limit(0)).count() == 0
    assert sorted(map(tuple, bpe.token_counts(df).collect())) == [(1, 2), (1, 2), (2, 0), (3, 0)]
