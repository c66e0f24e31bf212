"""Distinct counts (p1)."""

from __future__ import annotations

import tracemalloc
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tsq.llm import distinct, runs

SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("a", T.StringType()),
        T.StructField("b", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("addr", T.BinaryType()),
        T.StructField("n", T.LongType()),
        T.StructField("on_day", T.StringType()),  # a clashing name
    ]
)
PLANS = [
    {"plan_id": 1, "by": ["a"], "field": "key"},
    {"plan_id": 2, "by": ["a", "b"], "field": "addr"},
    {"plan_id": 3, "by": [], "field": "n"},
]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=30), max_size=8))
def test_runs_round_trip(sets):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    starts = np.cumsum([0, *map(len, arrays)])[:-1] if arrays else np.zeros(0, np.int64)
    packed = runs.pack(values, starts.astype(np.int64))
    back, run = runs.unpack(pa.chunked_array([packed]))
    assert back.tolist() == values.tolist()
    assert run.tolist() == [i for i, s in enumerate(arrays) for _ in s]


def rows(n=3000):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        t = datetime(2025, 1, 1) + timedelta(hours=int(rng.integers(0, 70)))
        a = ["hot", "hot", "hot", None, "x|y", "<null>"][rng.integers(6)]
        b = [None, "p", "q", ""][rng.integers(4)]
        key = None if rng.random() < 0.1 else f"k{rng.integers(500)}"
        addr = None if rng.random() < 0.1 else bytes(rng.integers(0, 7, 4).tolist())
        out.append((t, a, b, key, addr, None if rng.random() < 0.1 else int(rng.integers(-50, 50)), "x"))
        if rng.random() < 0.05:
            out.append(out[-1])
    return out


def brute(data):
    out: dict = {}
    at = {"a": 1, "b": 2, "key": 3, "addr": 4, "n": 5}
    for p in PLANS:
        for k in range(len(p["by"]) + 1):
            for kept in combinations(p["by"], k):
                for r in data:
                    if r[at[p["field"]]] is None:
                        continue
                    key = tuple(r[at[c]] for c in kept)
                    for day in (r[0].strftime("%Y-%m-%d"), "all"):
                        out.setdefault((p["plan_id"], "|".join(kept), key, day), set()).add(r[at[p["field"]]])
    return sorted(
        (p, labels, "|".join("<null>" if x is None else x for x in key), day, len(ids))
        for (p, labels, key, day), ids in out.items()
    )


@pytest.mark.parametrize("piece,batch,parts", [(1 << 20, 1 << 20, 1), (100, 64, 4), (7, 1, 7)])
def test_against_brute_force(spark, piece, batch, parts):
    data = rows()
    partials = distinct.partial_runs(spark.createDataFrame(data, SCHEMA).repartition(parts), PLANS, "ts")
    for source in (partials, distinct.merge_runs(partials, piece, batch)):
        got = distinct.distinct_counts(source, PLANS, piece, batch).collect()
        assert sorted(tuple(r)[:5] for r in got) == brute(data)
        assert all(r["error_bound"] == r["n_distinct"] * (r["n_distinct"] - 1) / 2**65 for r in got)


def test_partials_of_two_loads_combine(spark):
    data = rows()
    one, two = (distinct.partial_runs(spark.createDataFrame(d, SCHEMA), PLANS, "ts") for d in (data[:1000], data[1000:]))
    merged = distinct.merge_runs(one.unionByName(two), piece=50)
    assert sorted(tuple(r)[:5] for r in distinct.distinct_counts(merged, PLANS).collect()) == brute(data)
    assert merged.groupBy("plan_id", "on_day", "by_values", "hash_range").count().where("count > 1").isEmpty()


def test_only_large_cells_are_cut(spark):
    """The runs of small cells don't get shorter when large ones are cut finer."""
    data = rows()
    partials = distinct.partial_runs(spark.createDataFrame(data, SCHEMA).repartition(3), PLANS, "ts")
    cells = {}
    for piece in (1 << 20, 60, 20):
        for r in distinct.merge_runs(partials, piece).collect():
            cells.setdefault((r["plan_id"], r["on_day"], tuple(r["by_values"])), {}).setdefault(piece, []).append(r)
    for by_piece in cells.values():
        whole = by_piece[1 << 20]
        assert len(whole) == 1
        for piece in (60, 20):
            got = by_piece[piece]
            assert sum(r["n"] for r in got) == whole[0]["n"]
            assert len(got) == 1 or got[0]["bits"] > 0
            assert len(got) <= 1 << got[0]["bits"] < 2 * 3 * whole[0]["n"] / piece + 2
    assert any(len(c[20]) > 1 for c in cells.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sets(st.integers(0, 2**64 - 1), max_size=9), max_size=5), max_size=5))
def test_union_is_that_of_the_sets(cells):
    cell = np.array([i for i, sets in enumerate(cells) for s in sets for _ in s], np.int64)
    h = np.array([x for sets in cells for s in sets for x in sorted(s)], np.uint64)
    got = list(zip(*(x.tolist() for x in runs.union(cell, h))))
    assert got == [(i, x) for i, sets in enumerate(cells) for x in sorted(set().union(*sets))]


def test_small_batches(spark, monkeypatch):
    data = rows(500)
    monkeypatch.setattr(runs, "BATCH", 50)
    partials = distinct.partial_runs(spark.createDataFrame(data, SCHEMA), PLANS, "ts")
    assert sorted(tuple(r)[:5] for r in distinct.distinct_counts(partials, PLANS).collect()) == brute(data)


def test_a_batch_is_unpacked_in_slices(spark, monkeypatch):
    """However many hashes Spark puts into a batch, a task unpacks a bounded number."""
    whole, most = runs.unpack, 1000

    def bounded(col):
        values, run = whole(col)
        if len(values) > most:
            raise MemoryError(f"{len(values)} hashes at once")
        return values, run

    data = rows(6000)
    monkeypatch.setattr(distinct, "SLICE", 64, raising=False)
    monkeypatch.setattr(runs, "unpack", bounded)
    partials = distinct.partial_runs(spark.createDataFrame(data, SCHEMA).repartition(1), PLANS, "ts")
    assert sorted(tuple(r)[:5] for r in distinct.distinct_counts(partials, PLANS, 100, 64).collect()) == brute(data)


def test_memory_of_unpacking():
    h = np.sort(np.random.default_rng(3).integers(0, 2**64, 1 << 17, np.uint64))
    col = pa.chunked_array([runs.pack(h, np.zeros(1, np.int64))])
    tracemalloc.start()
    try:
        assert runs.unpack(col)[0].tolist() == h.tolist()
        tracemalloc.reset_peak()
        runs.unpack(col)
        assert tracemalloc.get_traced_memory()[1] < 100 * len(h)
    finally:
        tracemalloc.stop()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), max_size=12), max_size=4), st.integers(1, 30))
def test_slices(batches, values):
    made = [pa.record_batch({"n": pa.array(b, pa.int64())}) for b in batches]
    got = [s["n"].to_pylist() for s in runs.slices(made, values)]
    assert [n for s in got for n in s] == [n for b in batches for n in b]
    assert all(s and (sum(s) <= values or len(s) == 1) for s in got)


def test_empty_and_only_null(spark):
    null = [(datetime(2025, 1, 1), "a", None, None, None, None, "x")]
    for data in ([], null):
        partials = distinct.partial_runs(spark.createDataFrame(data, SCHEMA), PLANS, "ts")
        assert distinct.distinct_counts(partials, PLANS).count() == 0
        assert distinct.merge_runs(partials).count() == 0
