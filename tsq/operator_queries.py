"""Queries for the operators below the engine: rows in memory, list functions, matchers
by type, index hints, errors and time arithmetic, each with its SQL.

Expected constants in the SQL (``VALUES``) are written out by hand; everything else is
computed over the whole test tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.catalog import Catalog, Table
from tsq.engine import Engine
from tsq.errors import TsqError
from tsq.functions import series
from tsq.metric_queries import AT, BEFORE, EVENTS, engine, query
from tsq.plans.logical import Call, Literal, MatcherOp, Projection, Scan
from tsq.schema import GridMeta, MetricSchema
from tsq.sources.memory import packed_rows
from tsq.sources.parquet import load_catalog, read, write
from tsq.streaming.selector import pull
from tsq.timemath import Duration, Instant, TimeRange
from tsq.types import FIELD_TYPES, LABEL_TYPES

USAGE, GAUGE = "edge.gateway.request_cost", "plant.probe.reading"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# Scans, batches, catalog.


@query(f"SELECT event_type, count(*) AS value FROM (SELECT DISTINCT event_type, user_id FROM events WHERE {BEFORE}) GROUP BY 1")
def scan_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of one row for each event type, pulled partition by partition."""
    counts = engine(spark, sf_dir).query("count(events) by (event_type)", at=AT)
    return _frame(spark, [tuple(r) for r in pull(counts)], "event_type string, value bigint")


# The five typed rows of the fixtures, one list of four slots each.
TYPED = MetricSchema.of(
    {"l0": "string", "l1": "ipv4", "l2": "ipv6", "l3": "int", "l4": "bool"}, {"v": "float64", "w": "int32"}
)
_TYPED_ROWS = [
    {},
    {"l0": "hello", "l1": "127.0.0.1", "l2": "::1", "l3": 1, "l4": True, "v": [1.0, None, 3.0, None]},
    {"l0": "world", "l1": "127.0.0.1", "l2": "::1", "l3": 1, "l4": True, "w": [1, 2, 3, 4]},
    {"l0": "hello", "l1": "127.0.0.1", "l2": "::1", "l3": 1, "l4": True},
]
_GRID = GridMeta(Instant.of("2025-01-01"), Duration(60_000), 4)


def _typed_engine(spark: SparkSession) -> Engine:
    catalog = Catalog()
    df = packed_rows(spark, TYPED, _GRID, _TYPED_ROWS)
    catalog.create_table(Table("typed", df, TYPED, _GRID, "chunk_start", packed=True))
    return Engine(spark, catalog)


@query(
    "SELECT * FROM (VALUES (NULL, 4, 0, 4, 0), ('hello', 4, 2, 4, 0), ('hello', 4, 0, 4, 0), ('world', 4, 0, 4, 4)) "
    "AS t(l0, n_v, stored_v, n_w, stored_w)"
)
def memory_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows from memory: samples that are not given are NULL, equal label sets
    stay apart."""
    stored = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    return _typed_engine(spark).catalog.get("typed").df.select(
        "l0",
        F.size("v").alias("n_v"),
        stored("v").alias("stored_v"),
        F.size("w").alias("n_w"),
        stored("w").alias("stored_w"),
    )


@query(
    "SELECT * FROM (VALUES ('string', 'label', 'string'), ('ipv4', 'label', 'binary'), ('ipv6', 'label', 'binary'), "
    "('int', 'label', 'bigint'), ('bool', 'label', 'boolean'), ('uint8', 'field', 'array<smallint>'), "
    "('uint16', 'field', 'array<int>'), ('uint32', 'field', 'array<bigint>'), "
    "('uint64', 'field', 'array<decimal(20,0)>'), ('int8', 'field', 'array<tinyint>'), "
    "('int16', 'field', 'array<smallint>'), ('int32', 'field', 'array<int>'), ('int64', 'field', 'array<bigint>'), "
    "('float32', 'field', 'array<float>'), ('float64', 'field', 'array<double>'), ('bool', 'field', 'array<boolean>')) "
    "AS t(type, role, stored_as)"
)
def batch_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a packed batch with every label and field type."""
    labels, fields = {f"l_{k}": k for k in LABEL_TYPES}, {f"f_{k}": k for k in FIELD_TYPES}
    df = packed_rows(spark, MetricSchema.of(labels, fields), _GRID, [])
    role = {"l": "label", "f": "field"}
    rows = [(f.name[2:], role[f.name[0]], f.dataType.simpleString()) for f in df.schema if f.name[1] == "_"]
    return _frame(spark, rows, "type string, role string, stored_as string")


@query(
    "SELECT event_type, user_id, ts, value FROM events UNION ALL "
    "SELECT event_type, user_id, ts, value FROM events WHERE event_type = 'click'"
)
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest by append: equal label sets and equal rows are kept as rows of their own."""
    e = engine(spark, sf_dir)
    e.catalog.append("events", e.catalog.get("events").df.where("event_type = 'click'"))
    return e.scan("events")


@query(
    "SELECT count(*) AS n_records, sum(coalesce(len(value), 0))::BIGINT AS n_slots FROM gauge_records"
)
def records_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load_catalog(spark, sf_dir).get(GAUGE).df
    slots = F.when(F.col("value").isNotNull(), F.size("value")).otherwise(0)
    return df.agg(F.count("*").alias("n_records"), F.sum(slots).alias("n_slots"))


@query("SELECT unnest(tags) AS tag, resource FROM metric_catalog")
def tagged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_catalog(spark, sf_dir)
    catalog.tag("no.such.table", ["edge"])  # ignored
    tags = {t for r in read(spark, f"{sf_dir}/metric_catalog.parquet").collect() for t in r["tags"] or []}
    rows = [(t, name) for t in tags for name in catalog.tables_by_tag(t)]
    return _frame(spark, rows, "tag string, resource string")


# Projections.


def _projected(spark: SparkSession, sf_dir: str, projection: Projection) -> DataFrame:
    return engine(spark, sf_dir).run(Scan("events", projection=projection))


@query("SELECT user_id, ts, value FROM events")
def projection_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a field added to an empty projection; adding again changes nothing."""
    empty = Projection((), ())
    return _projected(spark, sf_dir, empty.insert("label", "user_id").insert("field", "value").insert("label", "user_id"))


@query("SELECT user_id, event_type, ts, value FROM events")
def projection_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two projections, labels and fields alike."""
    return _projected(spark, sf_dir, Projection(("user_id",), ()).append(Projection(("event_type", "user_id"), ("value",))))


# Matchers.

_HIDDEN = "(SELECT nullif(event_type, 'view') AS event_type FROM events)"


@query(
    "SELECT op, is_positive, (SELECT count(*) FROM " + _HIDDEN + " WHERE CASE op "
    "WHEN '=' THEN event_type IS NOT DISTINCT FROM 'click' WHEN '!=' THEN event_type IS DISTINCT FROM 'click' "
    "WHEN '=~' THEN regexp_matches(event_type, 'click') ELSE NOT regexp_matches(event_type, 'click') END) AS n_rows "
    "FROM (VALUES ('=', true), ('!=', false), ('=~', true), ('!~', false)) AS t(op, is_positive)"
)
def matcher_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an operator is positive, and the rows it keeps: a positive and its
    negative share no row, and only ``!=`` keeps NULL."""
    e = engine(spark, sf_dir)
    parts = []
    for op in ("=", "!=", "=~", "!~"):
        matched = e.scan("events_nulls", [("event_type", op, "click")]).agg(F.count("*").alias("n_rows"))
        parts.append(matched.select(F.lit(op).alias("op"), F.lit(MatcherOp(op).positive).alias("is_positive"), "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "SELECT * FROM (VALUES ('same pattern', true), ('other pattern', false), ('other range', true), "
    "('pattern and literal', false), ('NULL and literal', false)) AS t(pair, equal)"
)
def matcher_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans are equal by their patterns' texts and whatever their time range."""
    e = engine(spark, sf_dir)
    one = e.parse('events{event_type=~"a.c"}', at=AT)
    pairs = {
        "same pattern": (one, e.parse('events{event_type=~"a.c"}', at=AT)),
        "other pattern": (one, e.parse('events{event_type=~"a.b"}', at=AT)),
        "other range": (one, replace(one, range=TimeRange())),
        "pattern and literal": (one, e.parse('events{event_type="a.c"}', at=AT)),
        "NULL and literal": (MatcherOp("="), e.matcher("events", "event_type", "=", "x").op),
    }
    return _frame(spark, [(k, a == b) for k, (a, b) in pairs.items()], "pair string, equal boolean")


@query(
    "SELECT hex(client_addr) AS client_addr, ts, value FROM usage_samples "
    "WHERE client_addr = (SELECT min(client_addr) FROM usage_samples) OR (client_addr IS NULL AND is_retry)"
)
def match_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one address, and those without address that are retries."""
    e = Engine(spark, load_catalog(spark, sf_dir))
    address = e.catalog.get(USAGE).df.agg(F.min("client_addr")).first()[0]
    some = e.scan(USAGE, [("client_addr", "=", bytes(address))], labels=["client_addr"], fields=["value"])
    no_address = [("client_addr", "=", None), ("is_retry", "=", True)]
    none = e.scan(USAGE, no_address, labels=["client_addr"], fields=["value"])
    return some.unionByName(none).withColumn("client_addr", F.hex("client_addr"))


@query(
    "SELECT instance, hex(probe_addr) AS probe_addr, count(*) AS n FROM gauge_records, unnest(value) AS u(v) "
    "WHERE v IS NOT NULL AND probe_addr IS DISTINCT FROM (SELECT max(probe_addr) FROM gauge_records) "
    "AND NOT is_backup GROUP BY ALL"
)
def match_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = load_catalog(spark, sf_dir)
    address = catalog.get(GAUGE).df.agg(F.max("probe_addr")).first()[0]
    matchers = [("probe_addr", "!=", bytes(address)), ("is_backup", "=", False)]
    rows = Engine(spark, catalog).scan(GAUGE, matchers, labels=["instance", "probe_addr"])
    counted = rows.groupBy("instance", "probe_addr").agg(F.count("*").alias("n"))
    return counted.withColumn("probe_addr", F.hex("probe_addr"))


@query("SELECT * FROM (VALUES ('l0 is NULL', 0::BIGINT, 1::BIGINT), ('all types', 2, 2)) AS t(matchers, n_hello, n_rows)")
def match_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label of each type matched at once."""
    e = _typed_engine(spark)
    every = [("l0", "=", "hello"), ("l1", "=", "127.0.0.1"), ("l2", "=", "::1"), ("l3", "=", 1), ("l4", "=", True)]
    cases = {"l0 is NULL": [("l0", "=", None)], "all types": every}
    parts = [
        e.scan_packed("typed", matchers, fields=["v"]).agg(
            F.lit(name).alias("matchers"), F.count(F.when(F.col("l0") == "hello", 1)).alias("n_hello"), F.count("*").alias("n_rows")
        )
        for name, matchers in cases.items()
    ]
    return parts[0].unionByName(parts[1])


@query(f"SELECT event_type, user_id, ts, value FROM events WHERE event_type = 'click' AND {BEFORE}")
def match_name_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric named by ``__name__``."""
    return engine(spark, sf_dir).query('{__name__="events", event_type="click"}', at=AT)


@query("SELECT event_type, user_id, ts, value FROM events WHERE false")
def empty_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range whose end is not after its start holds nothing."""
    e = engine(spark, sf_dir)
    turned = e.scan("events", start="2024-01-20", end="2024-01-10")
    return turned.unionByName(e.scan("events", start="2024-01-20", end="2024-01-20"))


# Index hints: the metric is written with them into the shared folder and read again.


def _indexed(spark: SparkSession, sf_dir: str, name: str) -> Engine:
    from tsq.plans.session import shared_path

    table = load_catalog(spark, sf_dir).get(name)
    path = shared_path(spark, "indexed")
    write(table, path)
    catalog = Catalog()
    catalog.create_table(replace(table, df=read(spark, path)))
    return Engine(spark, catalog)


_IN_ENV = "SELECT tenant, env, status, ts, value FROM usage_samples WHERE "


@query(_IN_ENV + "env = 'production' AND status = '200'")
def index_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with an inverted hint, positive matchers."""
    matchers = [("env", "=", "production"), ("status", "=", "200")]
    return _indexed(spark, sf_dir, USAGE).scan(USAGE, matchers, labels=["tenant", "env", "status"], fields=["value"])


@query(_IN_ENV + "env IS DISTINCT FROM 'production' AND status IS NOT NULL")
def index_inverted_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative matchers over an index keep every row that differs, NULL too."""
    matchers = [("env", "!=", "production"), ("status", "!=", None)]
    return _indexed(spark, sf_dir, USAGE).scan(USAGE, matchers, labels=["tenant", "env", "status"], fields=["value"])


@query(
    "SELECT client_key, ts, value FROM usage_samples WHERE client_key = (SELECT min(client_key) FROM usage_samples)"
)
def index_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label with a sparse hint: Bloom filters skip, the filter decides."""
    e = _indexed(spark, sf_dir, USAGE)
    key = e.catalog.get(USAGE).df.agg(F.min("client_key")).first()[0]
    return e.scan(USAGE, [("client_key", "=", key)], labels=["client_key"], fields=["value"])


@query(
    "SELECT client_key, ts, value FROM usage_samples WHERE client_key IS DISTINCT FROM 'no such key' "
    "AND client_key IS NOT NULL AND env = 'production'"
)
def index_absent_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that was never stored: nothing equals it, everything differs from it."""
    e = _indexed(spark, sf_dir, USAGE)
    none = e.scan(USAGE, [("client_key", "=", "no such key")], labels=["client_key"], fields=["value"])
    matchers = [("client_key", "!=", "no such key"), ("client_key", "!=", None), ("env", "=", "production")]
    return none.unionByName(e.scan(USAGE, matchers, labels=["client_key"], fields=["value"]))


@query(
    "SELECT column_name, index_kind, block_size::VARCHAR AS block_size FROM metric_schema "
    "WHERE index_kind IS NOT NULL AND column_role = 'label'"
)
def index_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared hints of all metrics."""
    catalog = load_catalog(spark, sf_dir)
    rows = []
    for name in catalog.names():
        for label, index in catalog.get(name).schema.index.items():
            size = None if index.block_size is None else str(index.block_size)
            rows.append((label, index.kind, size))
    return _frame(spark, rows, "column_name string, index_kind string, block_size string")


# Lists of samples.

_LISTS = "FROM gauge_records WHERE value IS NOT NULL"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, f"{sf_dir}/gauge_records.parquet").where("value IS NOT NULL")


@query(
    "SELECT record_id, (len(value) - list_count(value))::INTEGER AS n_filled, "
    f"len(value)::INTEGER AS n_samples {_LISTS}"
)
def list_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL samples become the constant -777."""
    padded = series.pad(F.col("value"), -777.0)
    filled = F.size(F.filter(padded, lambda v: v == -777.0))
    return _lists(spark, sf_dir).select("record_id", filled.alias("n_filled"), F.size(F.array_compact(padded)).alias("n_samples"))


@query(
    "SELECT record_id, len(value[11:20])::INTEGER AS n_part, value[11] AS first_in_part, value[51] AS first_of_rest, "
    f"greatest(len(value) - 50, 0)::INTEGER AS n_rest {_LISTS}"
)
def list_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples 10 <= i < 20, and those from 50 on."""
    part, rest = series.slice_range(F.col("value"), 10, 20), series.slice_range(F.col("value"), 50)
    return _lists(spark, sf_dir).select(
        "record_id",
        F.size(part).alias("n_part"),
        series.get(part, 0).alias("first_in_part"),
        series.get(rest, 0).alias("first_of_rest"),
        F.size(rest).alias("n_rest"),
    )


@query(f"SELECT record_id, value[1] AS v0, value[60] AS v59, NULL::DOUBLE AS v60 {_LISTS}")
def list_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by place; beyond the end there is none."""
    return _lists(spark, sf_dir).select("record_id", *[series.get(F.col("value"), i).alias(f"v{i}") for i in (0, 59, 60)])


@query(
    f"SELECT record_id, (len(value) + 2)::INTEGER AS n_samples, rack::DOUBLE AS before_last, NULL::DOUBLE AS last {_LISTS}"
)
def list_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two more samples, the second NULL."""
    longer = series.push(series.push(F.col("value"), F.col("rack").cast("double")), F.lit(None).cast("double"))
    return _lists(spark, sf_dir).select(
        "record_id",
        F.size(longer).alias("n_samples"),
        F.element_at(longer, -2).alias("before_last"),
        F.element_at(longer, -1).alias("last"),
    )


@query(
    "SELECT record_id, CASE WHEN len(value) > 3 THEN 0.5 END::DOUBLE AS v3, value[5] AS v4, "
    f"len(value)::INTEGER AS n_samples {_LISTS}"
)
def list_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample 3 set; a place beyond the end changes nothing."""
    value = series.set_sample(series.set_sample(F.col("value"), 3, 0.5), 600, 1.0)
    return _lists(spark, sf_dir).select(
        "record_id", series.get(value, 3).alias("v3"), series.get(value, 4).alias("v4"), F.size(value).alias("n_samples")
    )


@query(
    "WITH g AS (SELECT event_type, user_id, slot FROM (SELECT DISTINCT event_type, user_id FROM events), range(120) AS r(slot)), "
    "c AS (SELECT event_type, user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 21600000000 AS slot, "
    "first(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2, 3) "
    "SELECT event_type, user_id, TIMESTAMP '2024-01-01' + to_hours(CAST(slot * 6 AS INTEGER)) AS ts, "
    "coalesce(value, 0) AS value FROM g LEFT JOIN c USING (event_type, user_id, slot)"
)
def pad_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the registry by its name: empty slots of each chunk become 0."""
    return engine(spark, sf_dir).run(Call("pad", (Scan("events"), Literal("value"))))


# Errors.


def _errors(spark: SparkSession, cases: dict[str, Callable]) -> DataFrame:
    rows = []
    for name, run in cases.items():
        try:
            run()
            rows.append((name, "none"))
        except TsqError as e:
            rows.append((name, type(e).__name__))
    return _frame(spark, rows, "case_name string, error string")


@query(
    "SELECT * FROM (VALUES ('rate of a bool field', 'RateOfBool'), ('rate of a number', 'none'), "
    "('unknown function', 'UnknownFunction')) AS t(case_name, error)"
)
def function_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog()
    schema = MetricSchema.of({"event_type": "string"}, {"value": "float64", "big": "bool"})
    df = read(spark, f"{sf_dir}/events.parquet").withColumn("big", F.col("value") > 10)
    catalog.create_table(Table("flags", df, schema, GridMeta(Instant(0), Duration(1000)), "ts"))
    e = Engine(spark, catalog)
    every = Projection(None, None)
    return _errors(
        spark,
        {
            "rate of a bool field": lambda: e.run(Call("rate", (Scan("flags", projection=every), Literal("big")))),
            "rate of a number": lambda: e.run(Call("rate", (Scan("flags", projection=every), Literal("value")))),
            "unknown function": lambda: e.query("no_such(flags)", at=AT),
        },
    )


@query(
    "SELECT * FROM (VALUES ('no closing brace', 'ParsingWrong'), ('no metric', 'NoName'), ('wrong pattern', 'InvalidRegex'), "
    "('binary operator', 'Unsupported'), ('right text', 'none')) AS t(case_name, error)"
)
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    texts = {
        "no closing brace": 'events{event_type="click"',
        "no metric": '{event_type="click"}',
        "wrong pattern": 'events{event_type=~"("}',
        "binary operator": "events + events",
        "right text": 'sum(rate(events{event_type=~"c"}[1d])) by (event_type)',
    }
    return _errors(spark, {k: lambda t=t: e.parse(t, at=AT) for k, t in texts.items()})


@query(
    "SELECT * FROM (VALUES ('unknown resource', 'ResourceNotExists'), ('unknown label', 'NoColumn'), "
    "('pattern on a number', 'NoSupportRegex'), ('text for a number', 'TypeMismatch'), ('no such projection', 'NoColumn'), "
    "('group by no label', 'NoColumn'), ('table twice', 'TableExists'), ('right plan', 'none')) AS t(case_name, error)"
)
def check_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return _errors(
        spark,
        {
            "unknown resource": lambda: e.query("no.such.metric", at=AT),
            "unknown label": lambda: e.query('events{zone="a"}', at=AT),
            "pattern on a number": lambda: e.query('events{user_id=~"7"}', at=AT),
            "text for a number": lambda: e.query('events{user_id="7"}', at=AT),
            "no such projection": lambda: e.scan("events", labels=["zone"]),
            "group by no label": lambda: e.query("sum(events) by (zone)", at=AT),
            "table twice": lambda: e.catalog.create_table(e.catalog.get("events")),
            "right plan": lambda: e.query('events{event_type="click"}', at=AT),
        },
    )


@query(
    "SELECT * FROM (VALUES ('field of another type', 'SchemaMismatch'), ('no time column', 'SchemaMismatch'), "
    "('list in a long table', 'SchemaMismatch'), ('extra columns', 'none')) AS t(case_name, error)"
)
def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that a scan couldn't read are refused when they are registered."""
    df = read(spark, f"{sf_dir}/events.parquet")
    bad = {
        "field of another type": df.withColumn("value", F.col("value").cast("string")),
        "no time column": df.drop("ts"),
        "list in a long table": df.withColumn("value", F.array("value")),
        "extra columns": df.withColumn("extra", F.lit(1)),
    }
    grid = GridMeta(Instant(0), Duration(1000))
    return _errors(
        spark, {k: lambda d=d: Catalog().create_table(Table("t", d, EVENTS, grid, "ts")) for k, d in bad.items()}
    )


# Time.


@query(
    "SELECT plan_id, window_size_ms * 3 AS times_3, (window_size_ms // 7000)::BIGINT AS sevenths, "
    "(-(window_size_ms // 7000))::BIGINT AS minus_sevenths, (window_size_ms // 3600000)::BIGINT AS hours, "
    "-((window_size_ms + 1) // 3600000)::BIGINT AS minus_hours FROM aggregate_plans WHERE window_size_ms IS NOT NULL"
)
def duration_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and truncating quotients of the plans' window sizes (a fixed table)."""
    hour, rows = Duration.from_secs(3600), []
    for r in read(spark, f"{sf_dir}/aggregate_plans.parquet").where("window_size_ms IS NOT NULL").collect():
        d = Duration(r["window_size_ms"])
        minus = Duration(-d.millis)
        row = (r["plan_id"], (d * 3).as_millis(), (d / 7000).as_millis(), (minus / 7000).as_millis(), d / hour)
        rows.append((*row, Duration(-d.millis - 1) / hour))
    names = ("times_3", "sevenths", "minus_sevenths", "hours", "minus_hours")
    return _frame(spark, rows, "plan_id int, " + ", ".join(f"{n} bigint" for n in names))


@query(
    "SELECT resource, strftime(start_at, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown, epoch_ms(start_at) AS millis, "
    "epoch_ms(start_at) + unit_ms * width AS chunk_end, -86400000::BIGINT AS day_back, true AS is_past FROM metric_catalog"
)
def instant_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start of each metric's grid (a fixed table): shown, moved, compared with now."""
    rows = []
    catalog = load_catalog(spark, sf_dir)
    for name in catalog.names():
        g = catalog.get(name).grid
        back = (g.start_at - Duration(86_400_000)) - g.start_at
        end = g.start_at + g.unit * g.width
        same = Instant.from_millis(g.start_at.as_millis())
        rows.append((name, str(same), same.millis, end.millis, back.millis, same < Instant.now()))
    return _frame(
        spark, rows, "resource string, shown string, millis bigint, chunk_end bigint, day_back bigint, is_past boolean"
    )
