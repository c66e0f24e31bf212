"""Encoding (p6) against the vocabulary's own libraries, and round trips."""

from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.llm import encode, vocab

PATH = vocab.DEFAULT_VOCAB
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType())]
)
TEXTS = [
    None,
    "",
    " ",
    "   \n\n  ",
    "Hello world, it's <|endoftext|> 12345 days’ ...\r\n\tend ",
    "Größe straße ÀÉÎ ñandú œuvre",
    "从前有一个人住在青岛市里面。山高水长！",
    "قبل حتى عاسيس تيلقاسا",
    "при между регистрация объявление",
    "👩‍🌾🔥🧭 ½²³ ①Ⅳ",
    "á​‮﻿\x00\x1b\x85　 x",
    "x" * 3000,
    "ab" * 700 + " " * 300 + "1" * 500,
    "the the the " * 400,
    "'s't're've'm'll'd I'm YOU'LL",
]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.load_ranks(PATH), special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("hot_words", [1 << 17, 0, 100])
def test_same_ids_as_the_library(spark, reference, hot_words):
    df = encode.encode(frame(spark, TEXTS + TEXTS), hot_words=hot_words)
    got = {r["doc_id"]: list(r["ids"]) for r in df.collect()}
    assert len(got) == 2 * len(TEXTS)
    for i, t in enumerate(TEXTS + TEXTS):
        assert got[i] == (reference.encode_ordinary(t) if t else [])
    assert df.columns == ["doc_id", "text", "word", "ids"]


def test_same_ids_as_the_other_library(spark):
    from tokenizers import Tokenizer

    path = PATH.replace(".tiktoken", ".json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode(frame(spark, TEXTS)).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(TEXTS)}


def test_round_trip(spark):
    back = encode.decode(encode.encode(frame(spark, TEXTS)), text="back").collect()
    assert all(r["back"] == (r["text"] or "") for r in back)
    assert encode.decode(spark.createDataFrame([(None,)], "ids array<int>")).first()["text"] is None


def test_random_texts(spark, reference):
    from hypothesis import HealthCheck

    texts: list[str] = []

    @settings(max_examples=150, deadline=None, database=None, suppress_health_check=list(HealthCheck))
    @given(st.text(st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x1FFFF), max_size=40))
    def gather(t):
        texts.append(t)

    gather()
    df = encode.encode(frame(spark, texts))
    for r in df.collect():
        assert list(r["ids"]) == (reference.encode_ordinary(r["text"]) if r["text"] else []), repr(r["text"])


def test_very_long_words(spark, reference):
    """Through the fold, whatever the word's length: the library is only compared with."""
    import random

    mixed = "".join(random.Random(1).choices("abcdeésß", k=2_000))
    texts = ["x" * 100_001, "ab" * 5_000 + "a", "=" * 300_000 + " " * 100_000, "山" * 50_000, mixed, "aaab" * 999 + "aa"]
    df = encode.encode(frame(spark, texts))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in df.collect():
        assert list(r["ids"]) == reference.encode_ordinary(r["text"])


def test_vocabulary_whose_merges_rise(tmp_path):
    import base64

    assert vocab.merges_in_order(PATH) and vocab.merges_in_order(PATH.replace("50k", "multi_50k"))
    odd = [bytes([i]) for i in range(256)] + [b"abc", b"ab"]  # abc before its part
    file = tmp_path / "odd"
    file.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(odd)))
    assert not vocab.merges_in_order(str(file))


def test_empty_table(spark):
    assert encode.encode(frame(spark, [])).count() == 0


def test_cuts_never_split_a_piece():
    flags = vocab.joinable(PATH)
    for piece in list(vocab.load_ranks(PATH))[::97]:
        assert all(flags[a * 256 + b] for a, b in zip(piece, piece[1:]))


def test_pair_table_finds_every_pair_and_no_other():
    offsets, slots = vocab.pair_table(PATH)
    ranks = vocab.load_ranks(PATH)
    pieces = vocab.pieces(PATH)
    for piece, rank in list(ranks.items())[::53]:
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                assert slots[offsets[a] + b] ^ (a << 16) == rank
    for a in range(0, len(pieces), 911):
        for b in range(0, len(pieces), 409):
            got = int(slots[offsets[a] + b] ^ (a << 16))
            assert (got if got < vocab.PAIR_BASE else None) == ranks.get(pieces[a] + pieces[b])


def test_plan_shuffles_no_text(spark):
    df = encode.encode(frame(spark, TEXTS)).select(F.size("ids"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("regexp_extract_all") == 1  # words are cut once
    assert len(plan) < 100_000  # the literal tables are not spelled out
