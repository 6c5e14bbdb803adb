import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from interlock.llm.tokens import PATTERN, VOCABULARY, Encoder, encode, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    raw = open(VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return Encoder(raw), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_equals_the_library_and_round_trips(pair, text):
    mine, library = pair
    ids = mine.text(text)
    assert ids == library.encode_ordinary(text)
    assert b"".join(mine.bytes[i] for i in ids).decode() == text


def test_long_runs(pair):
    mine, library = pair
    for text in ("a" * 5000, " " * 4000 + "x", "0" * 3000, "<|endoftext|>", "ab" * 2000):
        assert mine.text(text) == library.encode_ordinary(text)


def test_null_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "x", "a"), (2, "", "y", "b"), (2, "the cat", "z", "c"), (None, "hi", "w", "d")], "doc_id long, text string, ids string, id string")
    got = sorted(((r["doc_id"], len(r["ids"])) for r in encode(df).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (2, 2), (None, 1)], key=str)
    counts = token_counts(df)
    assert counts.columns == ["doc_id", "ids", "id", "tokens"] and sum(r["tokens"] for r in counts.collect()) == 3
    assert encode(df.limit(0)).count() == 0
