"""Selectors, analysis, grid, rate and aggregation on small data."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tsq.catalog import Catalog, Table
from tsq.engine import Engine, limited
from tsq.errors import NoColumn, NoSupportRegex, ResourceNotExists, TypeMismatch, UnknownFunction, Unsupported
from tsq.functions import series
from tsq.operators import aggregate, grid
from tsq.plans.analyze import analyze
from tsq.plans.logical import Aggregate, Call, Literal, Projection, Scan, Window
from tsq.schema import GridMeta, MetricSchema
from tsq.sources.memory import long_rows, packed_rows
from tsq.timemath import Duration, Instant, TimeRange

T0 = datetime(2024, 1, 1)
FIVE = MetricSchema.of({"l0": "string", "l1": "ipv4", "l2": "ipv6", "l3": "int", "l4": "bool"}, {"value": "float64"})
MINUTE = GridMeta(Instant.of(T0), Duration(60_000), 4)
ONE = MetricSchema.of({"l": "string", "k": "string"}, {"value": "float64"})


def at(minutes: float) -> datetime:
    return T0 + timedelta(minutes=minutes)


def register(spark, schema, rows, name="m", grid_meta=MINUTE, **kwargs):
    catalog = Catalog()
    catalog.create_table(Table(name, long_rows(spark, schema, rows), schema, grid_meta, **kwargs))
    return Engine(spark, catalog)


@pytest.fixture(scope="module")
def five(spark):
    common = {"l1": "127.0.0.1", "l2": "::1", "l3": 1, "l4": True}
    rows = [{}, {"l0": "hello", **common}, {"l0": "world", **common}, {"l0": "hello", **common}]
    return register(spark, FIVE, [{"ts": at(i), "value": float(i), **r} for i, r in enumerate(rows)])


def values(df):
    return sorted(r["value"] for r in df.collect())


@pytest.mark.parametrize(
    "matchers,want",
    [
        ([("l0", "=", None)], [0]),
        ([("l0", "=", "hello"), ("l1", "=", "127.0.0.1"), ("l3", "=", 1)], [1, 3]),
        ([("l0", "!=", "hello")], [0, 2]),
        ([("l0", "!=", "never seen")], [0, 1, 2, 3]),
        ([("l0", "=", "never seen")], []),
        ([("l0", "!=", None)], [1, 2, 3]),
        ([("l0", "!~", "^h")], [2]),
        ([("l0", "=~", "o")], [1, 2, 3]),
        ([("l0", "=~", "o"), ("l0", "!=", "world")], [1, 3]),
        ([("l1", "!=", "127.0.0.1")], [0]),
        ([("l2", "=", "::1"), ("l4", "=", True)], [1, 2, 3]),
        ([("l4", "!=", True)], [0]),
        ([("l3", "=", None)], [0]),
    ],
)
def test_matchers(five, matchers, want):
    assert values(five.scan("m", matchers)) == want


def test_lookup(spark):
    rows = [{"l": x, "ts": at(i), "value": float(i)} for i, x in enumerate(["test", None, "hello", "world", "hello"])]
    engine = register(spark, ONE, rows)
    assert values(engine.scan("m", [("l", "=", "hello")])) == [2, 4]
    assert values(engine.scan("m", [("l", "=", "universe")])) == []
    assert values(engine.scan("m", [("l", "=", None)])) == [1]
    assert values(engine.scan("m", [("l", "=~", r"\w+?")])) == [0, 2, 3, 4]


def test_regex_classes_are_unicode(spark):
    engine = register(spark, ONE, [{"l": "日本", "ts": at(0), "value": 1.0}, {"l": "!", "ts": at(0), "value": 2.0}])
    assert values(engine.query(r'm{l=~"\\w"}')) == [1.0]


def test_time_range_is_half_open_and_regex_needs_values(spark):
    engine = register(spark, ONE, [{"l": "a", "ts": at(i), "value": float(i)} for i in range(5)])
    assert values(engine.query("m[2m]", at=at(3))) == [1, 2]
    assert values(engine.query("m[2m] offset 1m", at=at(3))) == [0, 1]
    assert values(engine.query("m", at=at(3))) == [0, 1, 2]
    assert values(engine.scan("m", start=at(3), end=at(3))) == []
    assert values(engine.scan("m", start=at(4), end=at(3))) == []


def test_projection_is_exact(five):
    assert five.scan("m", labels=["l3"]).columns == ["l3", "ts", "value"]
    assert five.scan("m", labels=[], fields=[]).columns == ["ts"]
    assert five.query("m").columns == ["l0", "l1", "l2", "l3", "l4", "ts", "value"]
    p = Projection(("a",), ("x",))
    assert p.insert("field", "y") == Projection(("a",), ("x", "y"))
    assert p.insert("label", "a") == p
    assert Projection(None, ("x",)).append(p) == Projection(None, ("x",))


def test_analysis_errors(five):
    with pytest.raises(ResourceNotExists, match="holds no metric n"):
        five.query("n")
    with pytest.raises(NoColumn, match="can't match by zz: not a column of m"):
        five.query('m{zz="1"}')
    with pytest.raises(TypeMismatch, match="l3: a value of type int is needed, not string"):
        five.query('m{l3="1"}')
    with pytest.raises(NoSupportRegex):
        five.query('m{l3=~"1"}')
    with pytest.raises(NoColumn, match="can't project"):
        five.scan("m", fields=["zz"])
    with pytest.raises(UnknownFunction):
        five.query("nothing(m)")
    with pytest.raises(NoColumn):
        five.query("sum(m) by (zz)")
    with pytest.raises(Unsupported):
        five.query("sum(sum(m))")
    with pytest.raises(TypeMismatch):
        five.scan("m", [("l3", "=", "x")])


def test_plans_stay_lazy_and_push_filters(spark, tmp_path):
    df = long_rows(spark, ONE, [{"l": "a", "k": "b", "ts": at(0), "value": 1.0}])
    df.write.parquet(str(tmp_path / "m"))
    catalog = Catalog()
    catalog.create_table(Table("m", spark.read.parquet(str(tmp_path / "m")), ONE, MINUTE))
    plan = Engine(spark, catalog).scan("m", [("l", "=", "a"), ("k", "!=", "z")], labels=["l"], start=at(0))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualNullSafe(l,a)" in text and "Not(EqualNullSafe(k,z))" in text and "GreaterThanOrEqual(ts" in text
    assert "Python" not in text


# Grid and functions.


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


@pytest.mark.parametrize(
    "xs,want", [([1, 3, 5, 7, 9, None, 12, 13], [2, 2, 2, 2, None, None, 1]), ([1], []), ([], [])]
)
def test_rate_kernel(spark, xs, want):
    got = spark.range(1).select(series.rate(ints(*xs)).alias("x"))
    assert got.first()["x"] == want
    assert got.schema["x"].dataType.elementType.simpleString() == "int"


def test_rate_of_bool(spark):
    engine = register(spark, MetricSchema.of({"l": "string"}, {"value": "bool"}), [])
    with pytest.raises(series.RateOfBool, match="need numbers"):
        engine.query("rate(m)")


def test_unsigned_differences_may_be_negative(spark):
    engine = register(
        spark,
        MetricSchema.of({"l": "string"}, {"value": "uint8"}),
        [{"l": "a", "ts": at(0), "value": 200}, {"l": "a", "ts": at(1), "value": 3}],
    )
    assert values(engine.query("rate(m)")) == [-197]


def test_list_functions(spark):
    xs = ints(None, 1, 2)
    assert one(spark, series.pad(xs, 0)) == [0, 1, 2]
    assert one(spark, series.slice_range(xs, 1, 2)) == [1]
    assert one(spark, series.slice_range(xs, 1)) == [1, 2]
    assert one(spark, series.slice_range(xs, 5)) == []
    assert [one(spark, series.get(xs, i)) for i in (0, 1, 3)] == [None, 1, None]
    assert one(spark, series.push(xs, F.lit(None).cast("int"))) == [None, 1, 2, None]
    assert one(spark, series.set_sample(xs, 0, 1)) == [1, 1, 2]
    assert one(spark, series.set_sample(xs, 9, 1)) == [None, 1, 2]


def test_slots_round_down(spark):
    rows = [{"l": "a", "ts": at(m), "value": 0.0} for m in (-0.5, 0, 0.99, 1, 59.999)]
    df = long_rows(spark, ONE, rows).orderBy("ts")
    got = [r[0] for r in df.select(grid.slot(F.col("ts"), df.schema["ts"].dataType, MINUTE)).collect()]
    assert got == [-1, 0, 0, 1, 59]
    assert grid.slot_range(MINUTE, TimeRange(Instant.of(at(0.5)), Instant.of(at(2.5)))) == (0, 2)


def test_times_do_not_depend_on_the_session_zone(spark):
    df = long_rows(spark, ONE, [{"l": "a", "ts": datetime(2024, 3, 31, 2, 30, 1, 123456), "value": 0.0}])
    kind = df.schema["ts"].dataType
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        from tsq.timemath import from_micros, micros

        row = df.select(micros(F.col("ts"), kind).alias("us"), from_micros(micros(F.col("ts"), kind), kind).alias("t")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row["us"] == 1711852201123456
    assert row["t"] == datetime(2024, 3, 31, 2, 30, 1, 123456)


def test_first_in_slot_pack_and_unpack(spark):
    rows = [
        {"l": "a", "ts": at(0.5), "value": 2.0},
        {"l": "a", "ts": at(0.2), "value": None},
        {"l": "a", "ts": at(0.3), "value": 1.0},
        {"l": "a", "ts": at(3), "value": 3.0},
        {"l": "a", "ts": at(5), "value": 5.0},
        {"l": None, "ts": at(1), "value": 7.0},
    ]
    df = long_rows(spark, ONE, rows)
    packed = grid.pack(df, ["l", "k"], "ts", "value", MINUTE)
    got = {(r["l"], r["chunk_start"]): r["value"] for r in packed.collect()}
    assert got == {
        ("a", at(0)): [1.0, None, None, 3.0],
        ("a", at(4)): [None, 5.0, None, None],
        (None, at(0)): [None, 7.0, None, None],
    }
    back = grid.unpack(packed, ["l", "k"], "chunk_start", ["value"], MINUTE)
    assert {(r["l"], r["ts"], r["value"]) for r in back.collect()} == {
        ("a", at(0), 1.0),
        ("a", at(3), 3.0),
        ("a", at(5), 5.0),
        (None, at(1), 7.0),
    }


def packed_engine(spark):
    schema = MetricSchema.of({"l": "string"}, {"value": "float64"})
    rows = [
        {"l": "a", "chunk_start": at(0), "value": [0.0, None, 2.0, 3.0]},
        {"l": "a", "chunk_start": at(4), "value": [4.0, 5.0, 6.0, None]},
        {"l": "b", "chunk_start": at(4), "value": None},
        {"l": "b", "chunk_start": at(8), "value": [8.0, 9.0, 10.0, 11.0]},
    ]
    catalog = Catalog()
    df = packed_rows(spark, schema, MINUTE, rows)
    catalog.create_table(Table("m", df, schema, MINUTE, "chunk_start", packed=True))
    return Engine(spark, catalog)


def test_packed_scans_are_trimmed(spark):
    engine = packed_engine(spark)
    assert values(engine.scan("m", start=at(2), end=at(6))) == [2, 3, 4, 5]
    assert values(engine.scan("m", [("l", "=", "b")], start=at(2), end=at(10.5))) == [8, 9]
    assert values(engine.scan("m", start=at(2.5), end=at(3.5))) == [2]  # whole slots
    assert values(engine.scan("m", start=at(6), end=at(6))) == []
    got = engine.scan_packed("m", [("l", "=", "a")], start=at(2), end=at(6)).collect()
    assert sorted((r["chunk_start"], r["value"]) for r in got) == [(at(2), [2.0, 3.0]), (at(4), [4.0, 5.0])]
    assert values(engine.query("m", at=at(1))) == [0]


def test_rate_is_gap_aware_and_bridges_chunks(spark):
    engine = packed_engine(spark)
    got = {(r["l"], r["ts"], r["value"]) for r in engine.run(Call("rate", (Scan("m"), Literal("value")))).collect()}
    assert got == {
        *((("a", at(m), 1.0)) for m in (3, 4, 5, 6)),
        *((("b", at(m), 1.0)) for m in (9, 10, 11)),
    }


def test_rate_takes_the_first_sample_of_a_slot(spark):
    rows = [
        {"l": "a", "ts": at(0.9), "value": 9.0},
        {"l": "a", "ts": at(0.1), "value": 1.0},
        {"l": "a", "ts": at(1.5), "value": 4.0},
        {"l": "a", "ts": at(3), "value": 8.0},
        {"l": None, "ts": at(0), "value": 1.0},
        {"l": None, "ts": at(1), "value": 3.0},
    ]
    got = register(spark, ONE, rows).query("rate(m)", at=at(10)).collect()
    assert {(r["l"], r["ts"], r["value"]) for r in got} == {("a", at(1), 3.0), (None, at(1), 2.0)}


# Aggregation.


@pytest.fixture(scope="module")
def groups(spark):
    rows = [
        {"l": "a", "k": "x", "ts": at(0), "value": None},
        {"l": "a", "k": "x", "ts": at(1), "value": 1.0},
        {"l": "a", "k": "x", "ts": at(2), "value": 100.0},
        {"l": "a", "k": "y", "ts": at(3), "value": 3.0},
        {"l": "b", "k": "x", "ts": at(4), "value": 5.0},
        {"l": None, "k": None, "ts": at(5), "value": 7.0},
    ]
    return register(spark, ONE, rows)


@pytest.mark.parametrize(
    "name,want",
    [
        ("sum", {"a": 4, "b": 5, None: 7}),
        ("avg", {"a": 2, "b": 5, None: 7}),
        ("min", {"a": 1, "b": 5, None: 7}),
        ("max", {"a": 3, "b": 5, None: 7}),
        ("count", {"a": 2, "b": 1, None: 1}),
        ("stddev", {"a": 1, "b": 0, None: 0}),
        ("stdvar", {"a": 1, "b": 0, None: 0}),
        ("group", {"a": 1, "b": 1, None: 1}),
    ],
)
def test_aggregates_take_the_first_of_each_series(groups, name, want):
    assert {r["l"]: r["value"] for r in groups.query(f"{name}(m) by (l)", at=at(9)).collect()} == want
    assert {r["l"]: r["value"] for r in groups.query(f"{name} without (k) (m)", at=at(9)).collect()} == want


def test_aggregate_of_all_and_windows(groups):
    assert groups.query("sum(m)", at=at(9)).collect()[0]["value"] == 16
    got = groups.query("sum(m) by (l)", at=at(9), window=timedelta(minutes=2)).collect()
    assert {(r["window_start"], r["l"]): r["value"] for r in got} == {
        (at(0), "a"): 1,
        (at(2), "a"): 103,
        (at(4), "b"): 5,
        (at(4), None): 7,
    }
    plan = Aggregate("sum", "with", ("l",), (Scan("m"), Literal("value")), Window("sum"))
    assert {r["l"]: r["value"] for r in groups.run(plan).collect()} == {"a": 104, "b": 5, None: 7}


def test_windows_align_to_the_range(groups):
    got = groups.query("count(m[3m]) by ()", at=at(4), window=timedelta(minutes=2))
    assert {r["window_start"]: r["value"] for r in got.collect()} == {at(1): 1, at(3): 1}


def test_empty_tables(spark):
    engine = register(spark, ONE, [])
    assert engine.query("m").count() == 0
    assert engine.query("rate(m)").count() == 0
    assert engine.query("sum(m) by (l)").count() == 0
    assert grid.pack(engine.catalog.get("m").df, ["l"], "ts", "value", MINUTE).count() == 0


def test_limit_is_exact_and_global(groups):
    assert [r["value"] for r in limited(groups.query("m", at=at(9)), 2, ["ts"]).collect()] == [None, 1.0]
    assert groups.query("m", at=at(9), limit=3).count() == 3


def test_plan_equality(groups):
    assert analyze(Scan("m"), groups.catalog) is not None
    assert Scan("m", range=TimeRange(Instant(0), None)) == Scan("m")


def test_one_shuffle_by_series_and_slot(groups):
    plan = groups.query("rate(m)", at=at(9))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Window" not in plan


def test_ties_of_any_sign_stay_in_their_microsecond(spark):
    """A negative tie-breaker comes before 0 of the same microsecond, and a great one
    before the next microsecond."""
    big = (1 << 63) - 1
    at = [datetime(2024, 1, 1, 0, 0, 0, us) for us in (0, 1)]
    kind = "g string, ts timestamp_ntz, tie bigint, value double"
    cases = {"a": [(1, -5, 1.0), (1, 3, 2.0)], "b": [(1, -big - 1, 1.0), (0, big, 2.0)], "c": [(1, -1, 1.0), (0, 0, 2.0)]}
    rows = [(g, at[us], tie, v) for g, xs in cases.items() for us, tie, v in xs]
    df = spark.createDataFrame(rows, kind)
    got = grid.first_in(df, ["g"], "value", grid.order_of(df, "ts", "tie")).collect()
    assert {r["g"]: r["value"] for r in got} == {"a": 1.0, "b": 2.0, "c": 2.0}


def test_pack_fills_gaps(spark):
    meta = GridMeta(Instant.of("2024-01-01"), Duration(60_000), 5)
    rows = [("a", datetime(2024, 1, 1, 0, m), float(m)) for m in (1, 3, 5, 9)] + [("b", datetime(2024, 1, 1, 0, 0), None)]
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, value double")
    got = {(r["g"], r["chunk_start"].minute): r["value"] for r in grid.pack(df, ["g"], "ts", "value", meta).collect()}
    assert got[("a", 0)] == [None, 1.0, None, 3.0, None] and got[("a", 5)] == [5.0, None, None, None, 9.0]
    assert got[("b", 0)] == [None] * 5
