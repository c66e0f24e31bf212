"""Trailing totals (p3) against brute force."""

from __future__ import annotations

from collections import deque
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tsq.operators import rolling

FIRST, LAST = date(2025, 1, 1), date(2025, 1, 20)
SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("account", T.StringType()),
        T.StructField("units", T.LongType()),
        T.StructField("day", T.StringType()),  # a clashing name
    ]
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9)), max_size=40), st.integers(1, 6))
def test_two_stack_queue(steps, width):
    for fold, plain, neutral in ((np.add, sum, 0), (np.minimum, min, 99), (np.maximum, max, -99)):
        queue = rolling.TwoStackQueue(fold, np.array([neutral]))
        window: deque = deque()
        for x in steps:
            if x is None:
                if window:
                    queue.pop()
                    window.popleft()
            else:
                queue.push(np.array([x]))
                window.append(x)
                if len(window) > width:
                    queue.pop()
                    window.popleft()
            want = plain(window) if window else neutral
            assert len(queue) == len(window) and queue.value()[0] == want


def run(spark, rows, folds=("sum", "min", "max"), widths=(3, 7)):
    df = spark.createDataFrame(rows, SCHEMA)
    days = rolling.daily(df, "account", "ts", "units", "sample_id", FIRST, LAST)
    return rolling.trailing(days, FIRST, LAST, widths, folds).toPandas()


def brute(rows, width):
    once = {(r[0], r[1], r[2], r[3]) for r in rows if r[2] is not None and FIRST <= r[1].date() <= LAST}
    out = {}
    for account in {r[2] for r in once}:
        for d in range((LAST - FIRST).days + 1):
            day = FIRST + timedelta(days=d)
            inside = [r[3] for r in once if r[2] == account and r[3] is not None and 0 <= (day - r[1].date()).days < width]
            out[account, d] = (sum(inside), min(inside, default=None), max(inside, default=None))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        t = datetime(2024, 12, 30) + timedelta(hours=int(rng.integers(0, 24 * 25)))
        account = [None, "a", "b", "hot", "hot", "hot"][rng.integers(6)]
        units = None if rng.random() < 0.1 else int(rng.integers(-5, 20))
        rows.append((i, t, account, units, "x"))
        if rng.random() < 0.1:
            rows.append(rows[-1])
    got = run(spark, rows)
    for width in (3, 7):
        want = brute(rows, width)
        assert len(got) == len(want)
        for r in got.itertuples():
            clean = [None if x != x else x for x in (getattr(r, f"{f}_{width}") for f in ("sum", "min", "max"))]
            assert tuple(clean) == want[r.entity, r.day]


def test_entities_without_values_and_outside_rows(spark):
    t = datetime(2025, 1, 5)
    rows = [(1, t, "only null", None, ""), (2, datetime(2025, 2, 1), "outside", 1, ""), (3, t, None, 1, "")]
    got = run(spark, rows)
    assert set(got.entity) == {"only null"} and len(got) == 20
    assert (got.sum_7 == 0).all() and got.min_7.isna().all()


def test_doubles_and_more_folds(spark, monkeypatch):
    """Any associative fold over doubles; here the value of the greatest amount."""
    further = lambda a, b: np.where(np.abs(b) > np.abs(a), b, a)
    monkeypatch.setitem(rolling.FOLDS, "far", rolling.Fold("most", further, 0, 0.0))
    rng = np.random.default_rng(2)
    rows = [(i, datetime(2025, 1, 1) + timedelta(days=int(rng.integers(20))), "ab"[i % 2], float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id bigint, ts timestamp_ntz, account string, units double")
    days = rolling.daily(df, "account", "ts", "units", "sample_id", FIRST, LAST)
    for r in rolling.trailing(days, FIRST, LAST, [4], ["sum", "count", "min", "far"]).collect():
        at = FIRST + timedelta(days=r["day"])
        inside = [x for x in rows if x[2] == r["entity"] and 0 <= (at - x[1].date()).days < 4]
        most = [max(x[3] for x in inside if x[1] == t) for t in {x[1] for x in inside}]
        assert r["sum_4"] == pytest.approx(sum(x[3] for x in inside)) and r["count_4"] == len(inside)
        assert r["min_4"] == min((x[3] for x in inside), default=None)
        assert r["far_4"] == max(most, key=abs, default=0.0)


def test_empty(spark):
    assert len(run(spark, [])) == 0


def test_more_entities_than_a_batch_holds(spark, monkeypatch):
    monkeypatch.setattr(rolling, "LANES", 3)
    rows = [(i, datetime(2025, 1, 1 + i % 4), f"e{i % 25}", 1, "") for i in range(100)]
    got = run(spark, rows, folds=("sum",))
    assert len(got) == 25 * 20 and got[got.day == 19].sum_7.sum() == 0
    assert got[got.day == 3].sum_7.sum() == 100
    assert not got.duplicated(["entity", "day"]).any()


@pytest.mark.parametrize("name", ["p3_found", "p3_rolling"])
def test_queries(spark, sf_dir, name):
    from tests.oracle import assert_same, connect
    from tsq import queries

    assert_same(queries.queries()[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.oracle_sql()[name]).df())
