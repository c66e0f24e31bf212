"""Percentiles by multi-select (p5)."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import types as T

from tsq.llm import percentiles as pc

SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("a", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("target", T.StringType()),  # a clashing name
    ]
)
PLANS = [{"plan_id": 1, "by": ["a"], "field": "value"}, {"plan_id": 2, "by": [], "field": "size"}]


def rows(n=4000):
    rng = np.random.default_rng(7)
    out = []
    for i in range(n):
        t = datetime(2025, 1, 1) + timedelta(hours=int(rng.integers(0, 60)))
        a = ["hot", "hot", "hot", None, "x", "tiny"][min(5, int(rng.integers(7)))] if i % 200 else "rare"
        v = [None, math.nan, math.inf, -math.inf, 0.0, -0.0][rng.integers(6)] if rng.random() < 0.2 else float(np.round(rng.lognormal(3, 2), 2))
        out.append((t, a, v, None if rng.random() < 0.1 else int(rng.integers(-1000, 100000)), "x"))
    return out + out[:50]


def brute(data):
    cells: dict = {}
    for t, a, v, s, _ in data:
        for plan, key, x in ((1, "<null>" if a is None else a, v), (2, "", s)):
            if x is not None and x == x:
                for day in (t.strftime("%Y-%m-%d"), "all"):
                    cells.setdefault((plan, key, day), []).append(float(x) + 0.0)
    out = []
    for k, xs in cells.items():
        xs.sort()
        out.append((*k, len(xs), *(xs[(len(xs) * p + 999) // 1000 - 1] for p in pc.PERMILLES), 0))
    return sorted(out)


@pytest.mark.parametrize("limit", [pc.LOCAL_LIMIT, 300, 40])
def test_against_brute_force(spark, limit):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = pc.percentiles(pc.partial_values(df, PLANS, "ts"), local_limit=limit)
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_salted_joins_give_the_same(spark, monkeypatch):
    from tsq.plans import session

    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    monkeypatch.setattr(session, "SALTS", 3)
    data = rows(1000)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = pc.percentiles(pc.partial_values(df, PLANS, "ts"), local_limit=100)
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_partials_of_two_loads_combine(spark, monkeypatch):
    data = rows()
    monkeypatch.setattr(pc, "TASK_VALUES", 64)
    one, two = (pc.partial_values(spark.createDataFrame(d, SCHEMA), PLANS, "ts") for d in (data[:1500], data[1500:]))
    got = pc.percentiles(one.unionByName(two))
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_one_value_repeated(spark):
    data = [(datetime(2025, 1, 1), "a", 5.0, 1, "x")] * 500
    got = pc.percentiles(pc.partial_values(spark.createDataFrame(data, SCHEMA).repartition(4), PLANS, "ts"), local_limit=1)
    assert sorted(tuple(r) for r in got.collect()) == brute(data)


def test_empty_and_nothing_to_rank(spark):
    null = [(datetime(2025, 1, 1), "a", None, None, "x"), (datetime(2025, 1, 1), "a", math.nan, None, "x")]
    for data in ([], null):
        assert pc.percentiles(pc.partial_values(spark.createDataFrame(data, SCHEMA), PLANS, "ts")).count() == 0


def test_ranks_are_exact():
    n = np.array([1, 2, 10, 999, 1000, 1001, 10**12])
    for i, p in enumerate(pc.PERMILLES):
        assert pc.ranks(n)[:, i].tolist() == [-(-int(x) * p // 1000) for x in n]


def test_ruled_out_values_are_discarded(spark, monkeypatch):
    """Each round reads fewer values than the one before."""
    sizes = []
    plain = pc._candidates

    def counted(partials):
        out = plain(partials)
        kept = out.selectExpr("sum(length(vals) div 8)").first()[0] or 0
        sizes.append((partials.selectExpr("sum(length(vals) div 8)").first()[0] or 0, kept))
        return out

    monkeypatch.setattr(pc, "_candidates", counted)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = pc.percentiles(pc.partial_values(df, PLANS, "ts"), local_limit=100)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows())
    assert len(sizes) > 2 and all(a[1] > b[1] for a, b in zip(sizes, sizes[1:]))


def test_search_of_many_stretches():
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.integers(0, 9, n)).astype(float) for n in (0, 1, 5, 40, 0)]
    v, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    begin = ends - [len(p) for p in parts]
    for x in range(-1, 10):
        for right in (True, False):
            got = pc.search(v, begin, ends, np.full(5, float(x)), right) - begin
            assert got.tolist() == [int(np.searchsorted(p, x, "right" if right else "left")) for p in parts]


def test_pivots_lie_among_the_middle(spark):
    """The two-level median leaves a quarter of the weight on either side."""
    rng = np.random.default_rng(4)
    rows_ = [(1, 0, float(m), int(w)) for m, w in zip(rng.normal(size=3000), rng.integers(1, 9, 3000))]
    df = spark.createDataFrame(rows_, "inst bigint, target int, median double, weight bigint")
    pivot = pc._pivots(df).first()["pivot"]
    whole = sum(w for *_, w in rows_)
    assert whole / 4 <= sum(w for _, _, m, w in rows_ if m <= pivot) <= whole * 3 / 4
