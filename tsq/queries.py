"""Named queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq import metric_queries, operator_queries  # noqa: F401  (registers its queries)
from tsq.metric_queries import flagship  # noqa: F401
from tsq.operators import frequency, rolling, spikes
from tsq.plans.aggregates import read_plans

Query = Callable[[SparkSession, str], DataFrame]
DAYS = 90  # the calendar of the metric tables, from the catalog's start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plans(spark: SparkSession, sf_dir: str) -> list[dict]:
    return read_plans(table(spark, sf_dir, "aggregate_plans"), table(spark, sf_dir, "metric_schema"))


def _calendar(spark: SparkSession, sf_dir: str, resource: str) -> tuple[date, date]:
    start = table(spark, sf_dir, "metric_catalog").where(F.col("resource") == resource).first()["start_at"].date()
    return start, start + timedelta(days=DAYS - 1)


# Problem 2: a few keys holding most records.


def _p2_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = [p for p in _plans(spark, sf_dir) if p["agg_name"] == "count"]
    return frequency.key_results(frequency.value_frequencies(table(spark, sf_dir, "usage_samples"), plans))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.hot_keys(_p2_results(spark, sf_dir)).select("plan_id", "by_key")


def p2_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("n_rows", "n_values", "n_distinct", "mode_value", "mode_n")
    return _p2_results(spark, sf_dir).select("plan_id", frequency.by_key(F.col("by_values")).alias("by_key"), *columns)


# Problem 3: rolling totals over trailing periods.


def _p3_trailing(spark: SparkSession, sf_dir: str, folds: list[str]) -> tuple[DataFrame, date]:
    plans = [p for p in _plans(spark, sf_dir) if p["agg_name"] in ("sum", "avg")]
    widths = sorted({p["window_ms"] // 86_400_000 for p in plans})
    first, last = _calendar(spark, sf_dir, plans[0]["resource"])
    samples = table(spark, sf_dir, "meter_samples")
    days = rolling.daily(samples, plans[0]["by"][0], "ts", plans[0]["field"], "sample_id", first, last)
    return rolling.trailing(days, first, last, widths, folds), first


def _on_day(first: date):
    return F.date_format(F.date_add(F.lit(first), F.col("day")), "yyyy-MM-dd").alias("on_day")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, first = _p3_trailing(spark, sf_dir, ["sum"])
    week, month = F.col("sum_7"), F.col("sum_30")
    # In whole numbers: week / 7 >= 3 * month / 30, or week / 7 <= month / 300.
    case = (week * 10 >= month * 7) | (week * 300 <= month * 7)
    return totals.where((F.col("day") >= 29) & (month > 0) & case).select(F.col("entity").alias("account"), _on_day(first))


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals, first = _p3_trailing(spark, sf_dir, ["sum", "min", "max"])
    return totals.select(
        F.col("entity").alias("account"),
        _on_day(first),
        F.col("sum_7").alias("total_7"),
        F.col("sum_30").alias("total_30"),
        (F.col("sum_7") / 7.0).alias("avg_7"),
        (F.col("sum_30") / 30.0).alias("avg_30"),
        F.col("min_7").cast("double").alias("least_7"),
        F.col("max_30").cast("double").alias("most_30"),
    )


# Problem 4: implausible spikes in measurements.

# Fixed value of the problem: counts jump by more than this, whatever their scatter.
JUMPS = {"queue_len": 100.0}


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "gauge_records")
    schema = table(spark, sf_dir, "metric_schema").where("resource = 'plant.probe.reading' AND column_role = 'label'")
    labels = [r["column_name"] for r in schema.orderBy("ordinal").collect()]
    return spikes.flag(records, table(spark, sf_dir, "quantity_limits"), labels, JUMPS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.found(p4_flags(spark, sf_dir))


def p4_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that don't depend on the usual scatter: impossible values and stuck
    stretches."""
    return p4_flags(spark, sf_dir).where(F.col("reason") != spikes.SPIKE)


def queries() -> dict[str, Query]:
    own = {f.__name__: f for f in (p2_found, p2_keys, p3_found, p3_rolling, p4_found, p4_flags, p4_plain)}
    return {**metric_queries.QUERIES, **own}


_P2_BY = {1: ["tenant"], 2: ["instance"], 3: ["route"], 4: ["tenant", "route"]}


def _p2_sql() -> str:
    parts = []
    for plan_id, by in _P2_BY.items():
        key = " || '|' || ".join(f"coalesce({c}, '<null>')" for c in by)
        groups = ", ".join(by)
        parts.append(
            f"SELECT {plan_id} AS plan_id, {key} AS by_key, sum(n)::BIGINT AS n_rows, "
            "coalesce(sum(n) FILTER (value IS NOT NULL), 0)::BIGINT AS n_values, count(value) AS n_distinct, "
            "first(value ORDER BY n DESC, value) FILTER (value IS NOT NULL) AS mode_value, "
            "coalesce(max(n) FILTER (value IS NOT NULL), 0)::BIGINT AS mode_n "
            f"FROM (SELECT {groups}, value, count(*) AS n FROM usage_samples GROUP BY {groups}, value) GROUP BY {groups}"
        )
    return " UNION ALL ".join(parts)


_P3_SQL = """
WITH once AS (
  SELECT DISTINCT sample_id, account, ts::DATE AS d, units FROM meter_samples
  WHERE account IS NOT NULL AND ts >= TIMESTAMP '2025-01-01' AND ts < TIMESTAMP '2025-04-01'
), daily AS (
  SELECT account, d, coalesce(sum(units), 0) AS total, min(units) AS least, max(units) AS most
  FROM once GROUP BY account, d
), grid AS (
  SELECT account, CAST(u AS DATE) AS d FROM (SELECT DISTINCT account FROM daily),
    unnest(generate_series(TIMESTAMP '2025-01-01', TIMESTAMP '2025-03-31', INTERVAL 1 DAY)) AS g(u)
), dense AS (
  SELECT account, d, coalesce(total, 0) AS total, least, most FROM grid LEFT JOIN daily USING (account, d)
), rolled AS (
  SELECT account, d,
    sum(total) OVER week AS total_7, sum(total) OVER month AS total_30,
    min(least) OVER week AS least_7, max(most) OVER month AS most_30
  FROM dense
  WINDOW week AS (PARTITION BY account ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    month AS (PARTITION BY account ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
"""


# Gaps and islands over the stored samples of each series; a NaN equals nothing.
_P4_SQL = """
WITH once AS (
  SELECT DISTINCT record_id, chunk_start, instance, quantity, probe_addr, rack, is_backup, value FROM gauge_records
), slots AS (SELECT *, unnest(generate_series(1, len(value))) AS i FROM once),
stored AS (
  SELECT record_id, (i - 1)::INTEGER AS slot, chunk_start, value[i] AS v, quantity,
    dense_rank() OVER (ORDER BY instance, quantity, probe_addr, rack, is_backup) AS series
  FROM slots WHERE value[i] IS NOT NULL
), ordered AS (
  SELECT *, lag(v) OVER w AS before, row_number() OVER w AS place FROM stored
  WINDOW w AS (PARTITION BY series ORDER BY chunk_start, record_id, slot)
), marked AS (
  SELECT *, CASE WHEN before IS NULL OR v <> before OR isnan(v) THEN 1 ELSE 0 END AS fresh FROM ordered
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY series ORDER BY place) AS island FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY series, island) AS size FROM islands),
judged AS (
  SELECT *, count(*) OVER s AS n, count(*) FILTER (size >= 15) OVER s AS held,
    count(*) FILTER (size >= 15 AND fresh = 0) OVER s AS resting, sum(fresh) OVER s - 1 AS changes
  FROM sized WINDOW s AS (PARTITION BY series)
)
"""
_P4_PLAIN = """
SELECT record_id, slot, 'stuck' AS reason FROM judged
WHERE size >= 15 AND held <= 0.5 * n AND changes >= 0.93 * (n - 1 - resting)
UNION ALL
SELECT record_id, slot, 'impossible' AS reason FROM stored LEFT JOIN quantity_limits USING (quantity)
WHERE isnan(v) OR isinf(v) OR coalesce(v < lower_limit, false) OR coalesce(v > upper_limit, false)
"""
# Spikes by another way than the operator's: runs of at most four samples beyond the
# limit from the median of the 21 samples around each.  Only the scatter is the same.
_P4_SPIKES = """
, possible AS (
  SELECT record_id, slot, quantity, series, v, row_number() OVER (PARTITION BY series ORDER BY place) AS place
  FROM ordered LEFT JOIN quantity_limits USING (quantity)
  WHERE NOT (isnan(v) OR isinf(v) OR coalesce(v < lower_limit, false) OR coalesce(v > upper_limit, false))
), p1 AS (
  SELECT *, lag(v) OVER w AS b1, lag(v, 2) OVER w AS b2, lead(v) OVER w AS a1,
    median(v) OVER (PARTITION BY series ORDER BY place ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS middle
  FROM possible WINDOW w AS (PARTITION BY series ORDER BY place)
), p2 AS (
  SELECT *, abs(v + coalesce(a1, v) - coalesce(b1, v) - coalesce(b2, b1, v)) / 2 AS detail,
    sum(CASE WHEN v = b1 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY place) AS island,
    CASE WHEN abs(v - round(v, 0)) <= 1e-9 * greatest(1, abs(v)) THEN 0
      WHEN abs(v - round(v, 1)) <= 1e-9 * greatest(1, abs(v)) THEN 1
      WHEN abs(v - round(v, 2)) <= 1e-9 * greatest(1, abs(v)) THEN 2
      WHEN abs(v - round(v, 3)) <= 1e-9 * greatest(1, abs(v)) THEN 3
      WHEN abs(v - round(v, 4)) <= 1e-9 * greatest(1, abs(v)) THEN 4
      WHEN abs(v - round(v, 5)) <= 1e-9 * greatest(1, abs(v)) THEN 5
      WHEN abs(v - round(v, 6)) <= 1e-9 * greatest(1, abs(v)) THEN 6 ELSE 7 END AS places
  FROM p1
), p3 AS (SELECT *, count(*) OVER (PARTITION BY series, island) AS size FROM p2),
p4 AS (
  SELECT *, lag(size) OVER (PARTITION BY series ORDER BY place) AS size_before,
    count(*) FILTER (size < 15) OVER s AS n_moving, count(*) OVER s AS n FROM p3 WINDOW s AS (PARTITION BY series)
), limits AS (
  SELECT series, CASE WHEN any_value(quantity) = 'queue_len' THEN 100.0 ELSE 10 * greatest(
    1.4826 * coalesce(quantile_disc(detail, 0.5) FILTER (size < 15 OR n_moving < 0.5 * n), 0),
    coalesce(min(abs(v - b1)) FILTER (v <> b1 AND size > 4 AND size_before > 4), power(10.0, -max(places)))) END AS far
  FROM p4 GROUP BY series HAVING count(*) >= 20
), hot AS (
  SELECT record_id, slot, series, place, CASE WHEN v - middle > far THEN 1 WHEN middle - v > far THEN -1 ELSE 0 END AS side
  FROM p4 JOIN limits USING (series)
), grouped AS (
  SELECT *, place - row_number() OVER (PARTITION BY series, side ORDER BY place) AS excursion FROM hot
)
"""
_P4_ALL = (
    _P4_SQL
    + _P4_SPIKES
    + _P4_PLAIN
    + "UNION ALL SELECT record_id, slot, 'spike' AS reason FROM (SELECT *, count(*) OVER (PARTITION BY series, side, excursion) "
    "AS width FROM grouped) WHERE side <> 0 AND width <= 4"
)


def oracle_sql() -> dict[str, str]:
    return {
        **metric_queries.SQL,
        "p4_flags": _P4_ALL,
        "p4_found": f"SELECT DISTINCT record_id, slot FROM ({_P4_ALL})",
        "p4_plain": _P4_SQL + _P4_PLAIN,
        "p2_found": f"SELECT plan_id, by_key FROM ({_p2_sql()}) "
        "WHERE n_rows > 0.02 * (SELECT count(*) FROM usage_samples)",
        "p2_keys": _p2_sql(),
        "p3_found": _P3_SQL
        + "SELECT account, strftime(d, '%Y-%m-%d') AS on_day FROM rolled WHERE d >= DATE '2025-01-30' "
        "AND total_30 > 0 AND (total_7 * 10 >= total_30 * 7 OR total_7 * 300 <= total_30 * 7)",
        "p3_rolling": _P3_SQL
        + "SELECT account, strftime(d, '%Y-%m-%d') AS on_day, total_7::BIGINT AS total_7, "
        "total_30::BIGINT AS total_30, total_7::BIGINT / 7.0::DOUBLE AS avg_7, total_30::BIGINT / 30.0::DOUBLE AS avg_30, "
        "least_7::DOUBLE AS least_7, most_30::DOUBLE AS most_30 FROM rolled",
    }
