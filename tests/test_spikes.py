"""Implausible readings (p4) on series with planted cases."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.operators import spikes

LABELS = ["instance", "quantity", "probe_addr"]
RECORDS = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("chunk_start", T.TimestampNTZType()),
        T.StructField("instance", T.StringType()),
        T.StructField("quantity", T.StringType()),
        T.StructField("probe_addr", T.BinaryType()),
        T.StructField("value", T.ArrayType(T.DoubleType())),
        T.StructField("block", T.StringType()),  # a clashing name
    ]
)
T0 = datetime(2025, 1, 1)


def noisy(n=900, level=20.0, scatter=0.5, seed=0):
    rng = np.random.default_rng(seed)
    return np.round(level + scatter * rng.standard_normal(n) + 2 * np.sin(np.arange(n) / 200), 2)


def masks(x, lower=-90.0, upper=150.0, jump=np.nan, **settings):
    x = np.asarray(x, float)
    bad = spikes.impossible(x, np.nan if lower is None else lower, np.nan if upper is None else upper)
    found = spikes.judge(x, np.zeros(len(x), np.int64), bad, np.array([jump]), **settings)
    return {k: np.flatnonzero(v).tolist() for k, v in found.items()}


def test_clean_series_have_no_cases():
    x = noisy()
    assert masks(x) == {"impossible": [], "spike": [], "stuck": []}
    stepped = x.copy()
    stepped[400:] += 30  # a lasting change of level
    stepped[890:] -= 60
    assert masks(stepped)["spike"] == []
    assert masks(x + np.arange(len(x)) * 0.05)["spike"] == []  # a trend
    plateau = x.copy()
    plateau[300:305] += 30  # five samples are no spike
    assert masks(plateau)["spike"] == []


def test_spikes_of_one_to_four_samples():
    for n in (1, 2, 3, 4):
        x = noisy(seed=n)
        x[500 : 500 + n] += 20
        x[100 : 100 + n] -= 20
        assert masks(x)["spike"] == [*range(100, 100 + n), *range(500, 500 + n)]
    x = noisy()
    x[200], x[201] = 60, -20  # to both sides
    assert masks(x)["spike"] == [200, 201]
    x = noisy()
    x[0] = 60
    x[-1] = -20
    assert masks(x)["spike"] == [0, len(x) - 1]


def test_impossible_values():
    x = noisy()
    x[5], x[6], x[7], x[8] = np.nan, np.inf, -np.inf, 150.01
    x[9] = 150.0  # a limit is possible, but a spike
    got = masks(x)
    assert got["impossible"] == [5, 6, 7, 8] and got["spike"] == [9]
    assert masks(x, None, None)["impossible"] == [5, 6, 7]


def test_stuck_only_in_series_that_change():
    x = noisy()
    x[300:315] = x[300]
    x[600:614] = 19.37  # too short
    assert masks(x)["stuck"] == list(range(300, 315))
    slow = np.repeat(np.round(noisy(60) * 2) / 2, 20)
    assert masks(slow)["stuck"] == []
    spiked = np.full(500, 7.0)
    spiked[250] = 57.0
    assert masks(spiked) == {"impossible": [], "spike": [250], "stuck": []}
    assert masks(np.full(500, 7.0)) == {"impossible": [], "spike": [], "stuck": []}


def test_slow_and_constant_series_use_their_step():
    x = np.repeat(np.array([20.0, 20.5] * 20), 25)
    x[77] = 24.9  # less than ten steps
    assert masks(x)["spike"] == []
    x[77] = 26.0
    assert masks(x)["spike"] == [77]
    flat = np.full(500, 44.27)
    flat[100:102] = 72.22, 69.01
    assert masks(flat)["spike"] == [100, 101]


def test_counts_that_jump():
    rng = np.random.default_rng(3)
    x = rng.poisson(2, 800).astype(float)
    x[50] = 90
    x[60] = 300
    assert masks(x, 0, None, 100.0)["spike"] == [60]


def test_short_series():
    for n in range(4):
        assert masks(np.arange(n, dtype=float)) == {"impossible": [], "spike": [], "stuck": []}


def records(spark, series, redeliver=(), start=T0, null_slots=True):
    rows, rid = [], 0
    for (instance, quantity, addr), x in series.items():
        for h in range(0, len(x), 60):
            chunk = [None if v is None else float(v) for v in x[h : h + 60]]
            row = (rid, start + timedelta(minutes=h), instance, quantity, addr, chunk, "x")
            rows.append(row)
            if rid in redeliver:
                rows.append(row)
            rid += 1
    rows.append((rid, T0, "a", "temp_c", None, None, "x"))
    return spark.createDataFrame(rows, RECORDS).repartition(3)


def limits(spark):
    return spark.createDataFrame(
        [("temp_c", -90.0, 150.0), ("free_bytes", 0.0, None)], "quantity string, lower_limit double, upper_limit double"
    )


def flagged(df):
    return sorted((r["record_id"], r["slot"]) for r in spikes.found(df).collect())


def test_series_cross_records_and_tasks(spark):
    x = list(noisy(60 * 24 * 9))
    boundary = 60 * 24
    x[boundary - 1], x[boundary] = 60.0, 61.0
    x[3000:3015] = [x[3000]] * 15
    x[3007] = None
    x[3015] = x[3000]
    y = list(noisy(600, 5.0, seed=9))
    y[30] = -1.0
    series = {("a", "temp_c", None): x, (None, "free_bytes", b"\1"): y}
    df = spikes.flag(records(spark, series, redeliver={23, 50}), limits(spark), LABELS)
    want = [(23, 59), (24, 0)]
    want += [(50, s) for s in range(16) if s != 7]
    want += [(len(x) // 60, 30)]
    assert flagged(df) == sorted(want)


def rough(n, seed):
    """A series with cases of every kind, some of them near each other."""
    rng = np.random.default_rng(seed)
    x = noisy(n, seed=seed)
    for at in rng.integers(0, n - 30, n // 60):
        kind, w = rng.integers(0, 5), rng.integers(1, 6)
        if kind == 0:
            x[at : at + w] += 25 * rng.choice([-1, 1])
        elif kind == 1:
            x[at : at + rng.integers(12, 20)] = x[at]
        elif kind == 2:
            x[at : at + 3 * w] = np.nan
        elif kind == 3:
            x[at:] += 15 * rng.choice([-1, 1])
        else:
            x[at : at + w] = 200.0
    return [None if rng.random() < 0.02 else v for v in x]


def test_a_series_in_many_tasks_is_judged_as_a_whole(spark):
    """One label tuple with most rows: the flags are those of the undivided series,
    whatever the tasks, pieces and batches."""
    x = rough(6000, 1)
    series = {("hot", "temp_c", None): x, ("b", "temp_c", None): rough(300, 2), ("z", "temp_c", b"\2"): rough(500, 3)}
    want, rid = [], 0
    for one in series.values():
        stored = np.array([i for i, v in enumerate(one) if v is not None])
        found = masks([one[i] for i in stored])
        assert len(one) < 6000 or all(found.values())
        want += [(rid + int(i) // 60, int(i) % 60, k) for k, at in found.items() for i in stored[at]]
        rid += -(-len(one) // 60)
    df = records(spark, series, redeliver={3, 40, 77}).cache()
    try:
        for tasks, piece, batch in ((1, 1 << 18, 1 << 19), (3, 1000, 700), (7, 90, 100), (40, 41, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
            got = spikes.flag(df, limits(spark), LABELS, piece=piece, batch=batch).collect()
            assert sorted((r["record_id"], r["slot"], r["reason"]) for r in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_spikes_come_from_the_details():
    x = noisy(seed=5)
    x[500:502] += 25
    x[100] -= 30
    assert masks(x)["spike"] == [100, 500, 501]
    assert masks(x, detail=np.inf)["spike"] == []  # no detail counts as an edge
    x[700] += 9
    assert masks(x)["spike"] == [100, 500, 501, 700]
    assert masks(x, detail=3.0)["spike"] == [100, 500, 501]  # the edges of 700 are too small
    # A gradual peak: its top lies beyond the limit, but nothing in it is sudden.
    peak = noisy(seed=6)
    peak[400:461] += 9.0 * np.exp(-(np.arange(-30, 31) ** 2) / 60.0)
    assert masks(peak)["spike"] == []


def test_spike_at_a_change_of_level():
    x = noisy(seed=7, scatter=0.3)
    x[300:] += 8
    x[300:304] -= 60
    assert masks(x)["spike"] == [300, 301, 302, 303]


def test_crowded_series(spark):
    # More records in one hour than a batch may hold: still every impossible sample.
    many = {(f"s{i}", "temp_c", None): [20.0, 999.0] for i in range(50)}
    shared = records(spark, many).withColumn("instance", F.lit("shared")).where("value is not null")
    assert len(flagged(spikes.flag(shared, limits(spark), LABELS, piece=41, batch=1))) == 50


def test_quantity_without_limits_and_empty(spark):
    series = {("a", "odd", None): [np.nan, 1.0, 2.0], ("b", None, None): [5.0, None, np.inf]}
    df = records(spark, series)
    assert flagged(spikes.flag(df, limits(spark), LABELS)) == [(0, 0), (1, 2)]
    assert flagged(spikes.flag(df.limit(0), limits(spark), LABELS)) == []
    only_null = df.where("value is null")
    assert flagged(spikes.flag(only_null, limits(spark), LABELS)) == []
    empty_list = spark.createDataFrame([(1, T0, "a", "temp_c", None, [], "x")], RECORDS)
    assert flagged(spikes.flag(empty_list, limits(spark), LABELS)) == []
