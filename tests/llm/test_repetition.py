"""Repetition inside a document (p8)."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tsq.llm import repetition as rep
from tsq.llm import vocab

pytestmark = pytest.mark.skipif(not os.path.exists(vocab.DEFAULT_VOCAB), reason="no vocabulary here")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("script", T.StringType())]
)


@pytest.fixture(scope="module")
def tools():
    return rep.splitter(), rep.Fertility(vocab.load_ranks(vocab.DEFAULT_VOCAB))


def measure(tools, text):
    return {k: v[0] for k, v in rep.measure([text], *tools, share=True).items()}


def share(tools, text):
    return measure(tools, text)["repeated_share"]


def brute(ids, points):
    n = len(ids)
    covered = [False] * n
    seen = set()
    for i in range(n):
        j, total = i, 0
        while j < n and total < rep.RUN:
            total += points[j]
            j += 1
        if total < rep.RUN:
            break
        run = tuple(ids[i:j])
        if run in seen:
            covered[i:j] = [True] * (j - i)
        seen.add(run)
    return covered


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([rep.WORD, rep.CHARACTER])), max_size=60), st.booleans())
def test_runs_against_brute_force(units, plain):
    ids = [u for u, _ in units]
    points = [rep.WORD if plain else (rep.CHARACTER if u % 2 else rep.WORD) for u in ids]
    got = rep.repeated(np.array(ids, np.int64), np.array(points, np.int64)).tolist()
    assert got == brute(ids, points)


def test_defined_results(tools):
    for text in (None, "", "   ", "\n\n", "12 34 5.6", "...", "​‮", "one two three four"):
        assert share(tools, text) == 0


def test_runs_of_five_words(tools):
    a = "alpha beta gamma delta epsilon"
    assert share(tools, f"{a} zeta {a}") == pytest.approx(26 / 56)
    assert share(tools, "alpha beta gamma delta. zeta alpha beta gamma delta") == 0
    assert share(tools, f"{a} zeta {a.upper()}!") == pytest.approx(26 / 56)
    assert share(tools, f"{a} zeta alpha,beta\n\ngamma  delta; ép​silon") == pytest.approx(26 / 56)


def test_numbers_do_not_make_a_passage_new(tools):
    text = "\n".join(f"item {i} costs {i}.5{i} per unit on {i}.3.2025" for i in range(1, 9))
    assert share(tools, text) == pytest.approx(7 / 8)


def test_loops(tools):
    assert share(tools, "so what " * 2) == 0
    assert share(tools, "so what " * 4) == pytest.approx(6 / 8)  # the run begins again at the third word
    assert share(tools, "so what " * 50) > 0.9
    assert share(tools, "spam " * 200) > 0.95
    assert share(tools, "去" * 200) > 0.9


def test_unspaced_scripts(tools):
    a = "山高水长春夏秋冬东南西北"
    assert len(a) == 12
    assert share(tools, f"{a}天{a}") == pytest.approx(12 / 25)
    assert share(tools, f"{a[:11]}天{a[:11]}地") == 0
    assert share(tools, f"{a}，天 {a[:6]}\n{a[6:]}") == pytest.approx(12 / 25)


def test_fertility(tools):
    got = measure(tools, "The quick brown fox jumps over the lazy dog. Größe 从前有一个人. " * 3)
    n = got["n_tokens"]
    assert got["script"] == "latin" and got["letters_per_token"] == pytest.approx(got["n_letters"] / n)
    assert 0 < got["fallback_share"] < 1 and 0 < got["token_entropy"] <= np.log2(n)
    assert got["run_deficit"] > 0.9 and got["repeated_share"] > 0.5
    # The cat sat on the cat: entropy of the tokens by hand.
    words = "the cat sat on the cat"
    ids = np.concatenate([tools[1].encoding.encode_ordinary(" " + w) for w in words.split()])
    p = np.unique(ids, return_counts=True)[1] / len(ids)
    assert measure(tools, words)["token_entropy"] == pytest.approx(-(p * np.log2(p)).sum())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("the cat of und der große 山 水 при 7".split()), max_size=60))
def test_the_deficit_is_twice_the_share_of_repeated_runs(tools, words):
    ids = [t for w in words for t in tools[1].encoding.encode_ordinary(" " + w)]
    runs = [tuple(ids[i : i + rep.RUN_TOKENS]) for i in range(len(ids) - rep.RUN_TOKENS + 1)]
    again = 1 - len(set(runs)) / len(runs) if runs else 0.0
    got = measure(tools, " ".join(words))["run_deficit"]
    counts = np.unique(runs, axis=0, return_counts=True)[1] if runs else np.ones(1)
    assert got == pytest.approx((counts * np.log2(counts)).sum() / max(len(runs), 1)) or not any(w.isalpha() for w in words)
    assert got >= 2 * again - 1e-9 or not any(w.isalpha() for w in words)


def test_documents_are_measured_alike_in_any_batch(tools):
    texts = ["alpha beta " * 9, None, "от слов " * 4, "", "去" * 30, "one two", "alpha beta " * 9]
    whole = rep.measure(texts, *tools, share=True)
    for i, t in enumerate(texts):
        for name, v in measure(tools, t).items():
            assert v == whole[name][i]


def test_bands_by_script(spark):
    """Medians and deviations within half a step; the rejected documents are those above
    the band of their own script."""
    rng = np.random.default_rng(1)
    rows = [("latin", float(v)) for v in rng.normal(4, 0.5, 999)] + [("greek", float(v)) for v in rng.normal(1, 0.1, 501)]
    table = spark.createDataFrame(
        [(i, s, 10, 10, v, 0.0, v, 0.1 * v) for i, (s, v) in enumerate(rows)], rep.SCHEMA
    )
    edges = {r["script"]: r for r in rep.bands(table, 3.0).collect()}
    for script in ("latin", "greek"):
        v = np.array([x for s, x in rows if s == script])
        mad = np.median(np.abs(v - np.median(v)))
        assert edges[script]["n_docs"] == len(v)
        assert edges[script]["token_entropy_low"] == pytest.approx(np.median(v) - 3 * 1.4826 * mad, abs=0.02)
        assert edges[script]["letters_per_token_high"] == pytest.approx(np.median(v) + 3 * 1.4826 * mad, abs=0.02)
    want = {i for i, (s, v) in enumerate(rows) if 0.1 * v > edges[s]["run_deficit_high"]}
    assert want and {r["doc_id"] for r in rep.rejected(table, rep.bands(table, 3.0)).collect()} == want


def test_found_reads_the_bands(spark, monkeypatch):
    a = "alpha beta gamma delta epsilon zeta eta theta "
    docs = spark.createDataFrame([(1, a * 5, "x"), (2, a, "x")], SCHEMA)
    assert [r["doc_id"] for r in rep.found(docs).collect()] == [1]
    monkeypatch.setattr(rep, "DEFICIT_EDGE", (99.0, 99.0))  # nothing lies above the band
    assert rep.found(docs).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    units = rep.splitter()
    ranks = vocab.load_ranks(vocab.DEFAULT_VOCAB)
    texts = [" ".join(f"word{chr(97 + i)}{chr(97 + j)}" for i in range(9)) for j in range(20)] * 2
    whole = rep.Fertility(ranks)
    want = [measure((units, whole), t) for t in texts]
    monkeypatch.setattr(rep, "KEPT_WORDS", 5)
    small = rep.Fertility(ranks)
    assert [measure((units, small), t) for t in texts] == want


def test_queries_of_small_tables(spark):
    a = "alpha beta gamma delta epsilon zeta eta theta "
    docs = spark.createDataFrame([(1, a * 5, "x"), (2, a, "x"), (3, None, "x"), (3, a + a, "x"), (4, "", "x")], SCHEMA)
    assert sorted(r["doc_id"] for r in rep.found(docs).collect()) == [1, 3]
    measures = rep.measured(docs)
    assert measures.count() == 5
    bands = {r["script"]: r for r in rep.bands(measures).collect()}
    assert set(bands) == {"latin", "none"} and bands["latin"]["n_docs"] == 3
    assert rep.found(docs.limit(0)).count() == 0 and rep.bands(measures.limit(0)).count() == 0


def test_long_text(tools):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(60_000)]
    assert share(tools, " ".join(words + words[:40_000])) == pytest.approx(0.4, abs=0.01)
    assert share(tools, "x" * 1_000_000) == 0
