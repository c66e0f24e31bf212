"""Per-key results under skew (p2)."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import types as T

from tsq.operators import frequency

SCHEMA = T.StructType(
    [
        T.StructField("a", T.StringType()),
        T.StructField("b", T.BinaryType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),  # clashing names
        T.StructField("plan_id", T.LongType()),
    ]
)
PLANS = [{"plan_id": 1, "by": ["a"], "field": "value"}, {"plan_id": 2, "by": ["a", "b"], "field": "value"}]


def results(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return frequency.key_results(frequency.value_frequencies(df, PLANS))


def test_exact_against_brute_force(spark):
    rows = []
    for i in range(500):
        a = ["hot", "hot", "hot", None, "x", ""][i % 6]
        v = [1.0, 2.0, None, math.nan, math.inf, float(i), -0.0, 0.0][i % 8]
        rows.append((a, bytes([1, 2]) if i % 3 else None, v, 1, 9))
    got = {(r["plan_id"], tuple(r["by_values"])): r for r in results(spark, rows).collect()}
    for plan in PLANS:
        keys: dict = {}
        for a, b, v, _, _ in rows:
            key = (a,) if plan["plan_id"] == 1 else (a, None if b is None else b.hex().upper())
            keys.setdefault(key, []).append(v)
        for key, vs in keys.items():
            r = got.pop((plan["plan_id"], key))
            present = [("nan" if v != v else v + 0.0) for v in vs if v is not None]
            counts = Counter(present)
            assert (r["n_rows"], r["n_values"], r["n_distinct"]) == (len(vs), len(present), len(counts))
            best = max(counts.values(), default=0)
            assert r["mode_n"] == best
            if best:
                least = min((v for v in counts if counts[v] == best), key=lambda v: math.inf if v == "nan" else v)
                assert r["mode_value"] == least or (least == "nan" and math.isnan(r["mode_value"]))
    assert not got


def test_hot_keys_are_above_the_share(spark):
    rows = [("hot", None, 1.0, 0, 0)] * 51 + [("even", None, None, 0, 0)] * 2 + [(f"k{i}", None, 1.0, 0, 0) for i in range(47)]
    hot = {(r["plan_id"], r["by_key"]) for r in frequency.hot_keys(results(spark, rows), 0.02).collect()}
    assert hot == {(1, "hot"), (2, "hot|<null>")}  # exactly 2 of 100 is not above 2 %


def test_only_null_values_and_empty(spark):
    r = results(spark, [("a", None, None, 0, 0)]).where("plan_id = 1").first()
    assert (r["n_rows"], r["n_values"], r["n_distinct"], r["mode_value"], r["mode_n"]) == (1, 0, 0, None, 0)
    assert results(spark, []).count() == 0
    assert frequency.hot_keys(results(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["p2_found", "p2_keys"])
def test_queries(spark, sf_dir, name):
    from tests.oracle import assert_same, connect
    from tsq import queries

    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.oracle_sql()[name]).df())
