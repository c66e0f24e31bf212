"""Queries for the engine's own operators over the test tables, and their SQL.

``events`` is a metric with labels event_type (string) and user_id (int), field value
and tie-breaker event_id; ``lineitem`` one with labels l_returnflag and l_linestatus,
time l_shipdate and its quantity as value.  ``events_nulls`` is ``events`` with
event_type 'view' taken as NULL.  Sums of doubles are rounded in both engines.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.catalog import Catalog, Table
from tsq.engine import Engine, limited
from tsq.functions import series
from tsq.operators import aggregate, grid
from tsq.plans.logical import Aggregate, Call, Literal, Scan, Window
from tsq.schema import GridMeta, MetricSchema
from tsq.sources.parquet import load_catalog, read
from tsq.timemath import Duration, Instant

Query = Callable[[SparkSession, str], DataFrame]

START, AT = "2024-01-01", "2024-01-31"
HOUR = Duration.from_secs(3600)
SIX_HOURS = Duration.from_secs(6 * 3600)
EVENTS = MetricSchema.of({"event_type": "string", "user_id": "int"}, {"value": "float64"})
LINES = MetricSchema.of({"l_returnflag": "string", "l_linestatus": "string"}, {"value": "float64"})


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine over ``events`` (6-hour slots, 120 a chunk), ``events_nulls`` and
    ``lineitem``."""
    catalog = Catalog()
    events = read(spark, f"{sf_dir}/events.parquet")
    meta = GridMeta(Instant.of(START), SIX_HOURS, 120)
    catalog.create_table(Table("events", events, EVENTS, meta, "ts", tie="event_id"))
    hidden = events.withColumn("event_type", F.nullif("event_type", F.lit("view")))
    catalog.create_table(Table("events_nulls", hidden, EVENTS, meta, "ts", tie="event_id"))
    lines = read(spark, f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_quantity", "value")
    day = GridMeta(Instant.of("1992-01-01"), Duration.from_secs(86_400), 1)
    catalog.create_table(Table("lineitem", lines, LINES, day, "l_shipdate"))
    return Engine(spark, catalog)


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _select(text: str, sql: str, name: str, at: str, table: str) -> None:
    """A selector query over all labels."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).query(text, at=at)

    run.__name__ = name
    query(f"SELECT event_type, user_id, ts, value FROM {table} WHERE {sql}")(run)


NULLS = "(SELECT * REPLACE (nullif(event_type, 'view') AS event_type) FROM events)"
BEFORE = f"ts < TIMESTAMP '{AT}'"

# text, SQL condition, name, evaluation time, table of the SQL
_SELECTORS = [
    ("events", BEFORE, "scan_all", AT, "events"),
    (
        'events{event_type="click"}[10d]',
        "event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
        "flagship_selector",
        "2024-01-20",
        "events",
    ),
    ('events{event_type="click"}', f"event_type IS NOT DISTINCT FROM 'click' AND {BEFORE}", "match_eq", AT, "events"),
    ('events{event_type!="click"}', f"event_type IS DISTINCT FROM 'click' AND {BEFORE}", "match_ne", AT, "events"),
    ('events{event_type=~"c|ea"}', f"regexp_matches(event_type, 'c|ea') AND {BEFORE}", "match_re", AT, "events"),
    ('events{event_type!~"c|ea"}', f"NOT regexp_matches(event_type, 'c|ea') AND {BEFORE}", "match_nre", AT, "events"),
    (
        'events_nulls{event_type!="click"}',
        f"event_type IS DISTINCT FROM 'click' AND {BEFORE}",
        "match_ne_keeps_null",
        AT,
        NULLS,
    ),
    (
        'events_nulls{event_type!~"c.*k"}',
        f"NOT regexp_matches(event_type, 'c.*k') AND {BEFORE}",
        "match_nre_drops_null",
        AT,
        NULLS,
    ),
    ('events_nulls{event_type=~"."}', f"regexp_matches(event_type, '.') AND {BEFORE}", "match_re_drops_null", AT, NULLS),
    (
        "events[3d]",
        "ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-15'",
        "range_selector",
        "2024-01-15",
        "events",
    ),
    (
        "events[2d] offset 1w",
        "ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-15'",
        "offset_selector",
        "2024-01-22",
        "events",
    ),
]
for _one_selector in _SELECTORS:
    _select(*_one_selector)


@query(f"SELECT event_type, user_id, ts, value FROM {NULLS} WHERE event_type IS NULL")
def match_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scan("events_nulls", [("event_type", "=", None)])


@query(f"SELECT event_type, user_id, ts, value FROM {NULLS} WHERE event_type IS NOT NULL")
def match_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scan("events_nulls", [("event_type", "!=", None)])


@query(
    f"SELECT event_type, user_id, ts, value FROM {NULLS} WHERE event_type IS DISTINCT FROM 'click' "
    "AND regexp_matches(event_type, 'e') AND user_id IS DISTINCT FROM 7"
)
def match_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    matchers = [("event_type", "!=", "click"), ("event_type", "=~", "e"), ("user_id", "!=", 7)]
    return engine(spark, sf_dir).scan("events_nulls", matchers)


@query("SELECT event_type, user_id, ts, value FROM events WHERE user_id = 7")
def match_int_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scan("events", [("user_id", "=", 7)])


@query("SELECT ts, value FROM events WHERE event_type = 'click'")
def projection_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scan("events", [("event_type", "=", "click")], labels=[])


@query("SELECT user_id, ts FROM events")
def projection_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).scan("events", labels=["user_id"], fields=[])


@query(
    "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 21600000000 AS slot FROM events"
)
def grid_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).catalog.get("events")
    return t.df.select("event_id", grid.slot(F.col("ts"), t.time_type, t.grid).alias("slot"))


_FIRST = "first(value ORDER BY ts, event_id)"


@query(
    f"SELECT event_type, user_id, date_trunc('hour', ts) AS window_start, {_FIRST} AS value "
    "FROM events GROUP BY 1, 2, 3"
)
def window_first_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).catalog.get("events")
    return aggregate.per_window(t.df, EVENTS.label_names, "ts", "value", "first", HOUR, tie="event_id")


@query(f"SELECT event_type, user_id, {_FIRST} AS value FROM events GROUP BY 1, 2")
def window_first_depends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).catalog.get("events")
    return aggregate.per_window(t.df, EVENTS.label_names, "ts", "value", "first", tie="event_id")


_SLOTS = (
    "SELECT event_type, user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 21600000000 AS slot, "
    f"{_FIRST} AS value FROM events GROUP BY 1, 2, 3"
)
_SLOT_TS = "TIMESTAMP '2024-01-01' + to_hours(CAST(slot * 6 AS INTEGER))"


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = engine(spark, sf_dir).catalog.get("events")
    return grid.pack(t.df, EVENTS.label_names, "ts", "value", t.grid, "event_id")


@query(
    "SELECT event_type, user_id, TIMESTAMP '2024-01-01' + to_days(CAST(30 * (slot // 120) AS INTEGER)) AS chunk_start, "
    "120 AS n_slots, count(value) AS n_samples, round(sum(value * (slot % 120 + 1)), 3) AS weighted "
    f"FROM ({_SLOTS}) GROUP BY ALL"
)
def pack_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed form by its size, samples and a sum that weighs each by its place."""
    weighted = F.aggregate(
        F.transform("value", lambda v, i: F.coalesce(v, F.lit(0.0)) * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return _packed(spark, sf_dir).select(
        "event_type",
        "user_id",
        "chunk_start",
        F.size("value").alias("n_slots"),
        F.size(F.filter("value", lambda v: v.isNotNull())).cast("long").alias("n_samples"),
        F.round(weighted, 3).alias("weighted"),
    )


@query(f"SELECT event_type, user_id, {_SLOT_TS} AS ts, value FROM ({_SLOTS})")
def unpack_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = engine(spark, sf_dir).catalog.get("events").grid
    return grid.unpack(_packed(spark, sf_dir), EVENTS.label_names, "chunk_start", ["value"], meta)


_RATES = (
    f"SELECT event_type, user_id, {_SLOT_TS} AS ts, value - before AS value FROM (SELECT *, "
    "lag(value) OVER w AS before, lag(slot) OVER w AS slot_before FROM "
    f"({_SLOTS}) WINDOW w AS (PARTITION BY event_type, user_id ORDER BY slot)) "
    "WHERE slot - slot_before = 1"
)


@query(_RATES)
def rate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run(Call("rate", (Scan("events"), Literal("value"))))


@query(_RATES)
def rate_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list kernel over packed rows (one chunk each), its results unpacked: sample i
    of the output lies in slot i + 1."""
    meta = engine(spark, sf_dir).catalog.get("events").grid
    rates = _packed(spark, sf_dir).withColumn(
        "value", F.concat(F.array(F.lit(None).cast("double")), series.rate(F.col("value")))
    )
    return grid.unpack(rates, EVENTS.label_names, "chunk_start", ["value"], meta)


def _aggregate(text: str, spark: SparkSession, sf_dir: str, *keys: str, digits: int = 4, **kwargs) -> DataFrame:
    df = engine(spark, sf_dir).query(text, at=AT, **kwargs)
    return df.withColumn("value", F.round("value", digits))


_ONE = f"(SELECT event_type, user_id, {_FIRST} AS v FROM events WHERE {BEFORE} GROUP BY 1, 2)"


@query(f"SELECT event_type, round(sum(v), 4) AS value FROM {_ONE} GROUP BY 1")
def sum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate("sum(events) by (event_type)", spark, sf_dir)


@query(f"SELECT event_type, round(sum(v), 4) AS value FROM {_ONE} GROUP BY 1")
def sum_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate("sum without (user_id) (events)", spark, sf_dir)


@query(f"SELECT round(sum(v), 4) AS value FROM {_ONE}")
def sum_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate("sum(events)", spark, sf_dir)


for _name, _sql in (
    ("avg", "round(avg(v), 4)"),
    ("min", "round(min(v), 4)"),
    ("max", "round(max(v), 4)"),
    ("count", "count(v)"),
    ("stddev", "round(stddev_pop(v), 4)"),
    ("stdvar", "round(var_pop(v), 3)"),
    ("group", "1.0::DOUBLE"),
):

    def _run(spark: SparkSession, sf_dir: str, _name: str = _name) -> DataFrame:
        return _aggregate(f"{_name}(events) by (event_type)", spark, sf_dir, digits=3 if _name == "stdvar" else 4)

    _run.__name__ = f"{_name}_by"
    query(f"SELECT event_type, {_sql} AS value FROM {_ONE} GROUP BY 1")(_run)


@query(
    f"SELECT event_type, round(sum(v), 4) AS value FROM (SELECT event_type, user_id, first(value ORDER BY ts) AS v "
    f"FROM ({_RATES}) GROUP BY 1, 2) GROUP BY 1"
)
def sum_by_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate("sum(rate(events)) by (event_type)", spark, sf_dir)


@query(
    "SELECT event_type, date_trunc('day', ts) AS window_start, round(sum(v), 4) AS value FROM "
    "(SELECT event_type, user_id, date_trunc('day', ts) AS ts, first(value ORDER BY ts) AS v "
    f"FROM ({_RATES}) r GROUP BY event_type, user_id, date_trunc('day', r.ts)) GROUP BY ALL"
)
def sum_by_rate_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aggregate("sum(rate(events)) by (event_type)", spark, sf_dir, window=timedelta(days=1))


@query("SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 100")
def limit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, f"{sf_dir}/events.parquet").select("event_id", "event_type", "value")
    return limited(events, 100, ["event_id"])


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2"
)
def lineitem_sum_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of each label group, by a sum in the window of each series."""
    by = ("l_returnflag", "l_linestatus")
    plan = Aggregate("sum", "with", by, (Scan("lineitem"), Literal("value")), Window("sum"))
    return engine(spark, sf_dir).run(plan).withColumn("value", F.round("value", 2))


# The metrics declared by the test tables themselves.


@query(
    "SELECT tenant, instance, route, env, status, client_key, hex(client_addr) AS client_addr, "
    "account_no::VARCHAR AS account_no, is_retry::VARCHAR AS is_retry, ts, value "
    "FROM usage_samples WHERE env IS DISTINCT FROM 'production' AND NOT regexp_matches(status, '^[23]') "
    "AND ts >= TIMESTAMP '2025-02-01' AND ts < TIMESTAMP '2025-02-08'"
)
def usage_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'edge.gateway.request_cost{env!="production", status!~"^[23]"}[1w]'
    rows = Engine(spark, load_catalog(spark, sf_dir)).query(text, at="2025-02-08")
    texts = {c: F.col(c).cast("string") for c in ("account_no", "is_retry")}
    return rows.withColumns({"client_addr": F.hex("client_addr"), **texts})


@query(
    "SELECT instance, quantity, rack::VARCHAR AS rack, ts, value FROM (SELECT instance, quantity, rack, is_backup, "
    "chunk_start + to_minutes(CAST(i - 1 AS INTEGER)) AS ts, value[i] AS value FROM "
    "(SELECT *, unnest(generate_series(1, len(value))) AS i FROM gauge_records WHERE quantity = 'temp_c' AND NOT is_backup)) "
    "WHERE value IS NOT NULL AND ts >= TIMESTAMP '2025-01-10 00:30' AND ts < TIMESTAMP '2025-03-01'"
)
def gauge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed metric read in long form, trimmed to a range within its chunks."""
    return Engine(spark, load_catalog(spark, sf_dir)).scan(
        "plant.probe.reading",
        [("quantity", "=", "temp_c"), ("is_backup", "=", False)],
        start="2025-01-10 00:30:00",
        end="2025-03-01",
        labels=["instance", "quantity", "rack"],
    ).withColumn("rack", F.col("rack").cast("string"))


@query(
    "WITH s AS (SELECT *, unnest(generate_series(1, len(value))) AS i FROM gauge_records), "
    "p AS (SELECT instance, quantity, probe_addr, rack, is_backup, "
    "chunk_start + to_minutes(CAST(i - 1 AS INTEGER)) AS ts, value[i] AS v FROM s), "
    "f AS (SELECT instance, quantity, rack, is_backup, probe_addr, date_trunc('hour', ts) AS h, "
    "first(v ORDER BY ts) AS v FROM p WHERE v IS NOT NULL GROUP BY ALL) "
    "SELECT instance, quantity, rack::VARCHAR AS rack, is_backup::VARCHAR AS is_backup, h AS window_start, "
    "max(v) AS value FROM f GROUP BY f.instance, f.quantity, f.rack, f.is_backup, f.h"
)
def gauge_max_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan 15: the first sample of each hour, the greatest over probe addresses."""
    plan = Aggregate(
        "max", "without", ("probe_addr",), (Scan("plant.probe.reading"), Literal("value")), Window("first", HOUR)
    )
    found = Engine(spark, load_catalog(spark, sf_dir)).run(plan)
    return found.withColumns({c: F.col(c).cast("string") for c in ("rack", "is_backup")})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_selector"](spark, sf_dir)
