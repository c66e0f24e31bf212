"""Mixing sources (p7)."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tsq.llm import mix, vocab

pytestmark = pytest.mark.skipif(not os.path.exists(vocab.DEFAULT_VOCAB), reason="no vocabulary here")
TARGETS = "mix_name string, source string, target_share double, max_repeats int"


def sizes(spark, counts, tokens=100):
    rows = [(1000 * i + j, s, tokens) for i, (s, n) in enumerate(counts.items()) for j in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens int").repartition(3)


def report(spark, counts, targets, **kwargs):
    s = sizes(spark, counts)
    rated = mix.rates(s, spark.createDataFrame(targets, TARGETS), **kwargs)
    return {(r["mix_name"], r["source"]): r for r in mix.shares(s, rated).collect()}, mix.mix(s, rated)


def test_shares_are_met_within_the_draw(spark):
    got, _ = report(spark, {"a": 900, "b": 100}, [("m", "a", 0.5, 1), ("m", "b", 0.5, 9)])
    assert got["m", "b"]["rate"] == 5.0 and got["m", "b"]["mix_docs"] == 500 and got["m", "b"]["most_repeats"] == 5
    assert got["m", "a"]["actual_share"] == pytest.approx(0.5, abs=0.03)


def test_max_repeats_and_missing_sources(spark):
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "none", 0.2, 3), ("n", "b", 1.0, 4)]
    got, rows = report(spark, {"a": 100, "b": 5, "unlisted": 50}, targets)
    b, none = got["m", "b"], got["m", "none"]
    assert b["rate"] == 2.0 and b["mix_tokens"] == 1000 and b["most_repeats"] == 2
    assert (none["n_docs"], none["source_tokens"], none["mix_tokens"], none["actual_share"]) == (0, 0, 0, 0)
    assert got["n", "b"]["rate"] == 1.0 and got["n", "b"]["actual_share"] == 1.0
    assert sum(r["actual_share"] for k, r in got.items() if k[0] == "m") == pytest.approx(1)
    assert rows.where("source = 'unlisted'").isEmpty()
    assert rows.where("source = 'b' AND mix_name = 'm'").count() == 10


def test_shortfall_and_the_size_without_caps(spark):
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.5, 2)]
    got, _ = report(spark, {"a": 100, "b": 5}, targets)
    # 105 documents of 100 tokens: b wants 5,250 and has at most 1,000.
    assert got["m", "b"]["shortfall"] == pytest.approx(4250) and got["m", "a"]["shortfall"] == 0
    most = got["m", "a"]["uncapped_size"]
    assert most == got["m", "b"]["uncapped_size"] == pytest.approx(2000)
    fits, _ = report(spark, {"a": 100, "b": 5}, targets, total_tokens=int(most))
    assert all(r["shortfall"] == 0 for r in fits.values()) and fits["m", "b"]["mix_tokens"] == 1000


def test_total_tokens(spark):
    got, _ = report(spark, {"a": 1000, "b": 1000}, [("m", "a", 0.25, 1), ("m", "b", 0.75, 1)], total_tokens=40_000)
    assert got["m", "a"]["rate"] == pytest.approx(0.1) and got["m", "b"]["mix_docs"] == pytest.approx(300, abs=50)


def test_copies_are_a_function_of_the_document(spark):
    df = spark.range(20_000).withColumn("c", mix.copies(F.lit(2.3), F.lit("m"), F.col("id")))
    counts = {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}
    assert set(counts) == {2, 3} and counts[3] / 20_000 == pytest.approx(0.3, abs=0.02)
    again = df.repartition(7).agg(F.sum(F.col("c") * F.col("id"))).first()[0]
    assert again == df.agg(F.sum(F.col("c") * F.col("id"))).first()[0]


def test_documents_to_mix(spark):
    docs = spark.createDataFrame(
        [(1, " A ", "hello world", "x"), (2, "a", None, "x"), (3, None, "hello", "x"), (4, "B ", "", "x")],
        "doc_id long, source string, text string, rate string",
    )
    s = mix.document_sizes(docs)
    assert {(r["doc_id"], r["source"], r["n_tokens"]) for r in s.collect()} == {(1, "a", 2), (2, "a", 0), (3, None, 1), (4, "b", 0)}
    targets = spark.createDataFrame([("m", "A", 1.0, 1), ("m", "a ", 0.5, 2), ("m", "b", 0.0, 1)], TARGETS)
    rated = mix.rates(s, targets)
    assert rated.count() == 2
    assert sorted(r["doc_id"] for r in mix.mix(s, rated).collect()) == [1, 2]
    empty = mix.document_sizes(docs.limit(0))
    assert mix.shares(empty, mix.rates(empty, targets)).agg(F.sum("mix_tokens")).first()[0] == 0
