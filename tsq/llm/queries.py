"""Queries p1, p5, p6, p7 and p8 over their whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsq.llm import distinct, encode, mix, percentiles, repetition
from tsq.operators.frequency import by_key
from tsq.plans.aggregates import read_plans
from tsq.plans.session import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plans(spark: SparkSession, sf_dir: str, agg_name: str) -> list[dict]:
    plans = read_plans(_table(spark, sf_dir, "aggregate_plans"), _table(spark, sf_dir, "metric_schema"))
    return [p for p in plans if p["agg_name"] == agg_name]


def _p1_partials(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    plans = _plans(spark, sf_dir, "distinct")
    return distinct.partial_runs(_table(spark, sf_dir, "usage_samples"), plans, "ts"), plans


def p1_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.distinct_counts(*_p1_partials(spark, sf_dir))


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct.merge_runs(_p1_partials(spark, sf_dir)[0])


def p1_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lengths of the merged runs of each plan, day and group, cells of more than
    4,096 hashes cut into ranges."""
    merged = distinct.merge_runs(_p1_partials(spark, sf_dir)[0], piece=4096)
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("on_day")), "yyyy-MM-dd")
    keyed = merged.select("plan_id", day.alias("on_day"), by_key(F.col("by_values")).alias("by_key"), "by_values", "n")
    sums = keyed.groupBy("plan_id", "on_day", "by_values", "by_key").agg(F.sum("n").alias("n_distinct"))
    return sums.drop("by_values")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = _table(spark, sf_dir, "usage_samples")
    return percentiles.percentiles(percentiles.partial_values(usage, _plans(spark, sf_dir, "quantile"), "ts"))


def p5_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same percentiles with groups of more than 64 values going through the rounds
    of the selection."""
    usage = _table(spark, sf_dir, "usage_samples")
    plans = _plans(spark, sf_dir, "quantile")
    return percentiles.percentiles(percentiles.partial_values(usage, plans, "ts"), local_limit=64)


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(_documents(spark, sf_dir, "text")).select("doc_id", "ids")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.decode(p6_ids(spark, sf_dir)).select("doc_id", "text")


def _p7(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = mix.document_sizes(_documents(spark, sf_dir, "source", "text"))
    return sizes, mix.rates(sizes, _table(spark, sf_dir, "mix_targets"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(*_p7(spark, sf_dir))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.shares(*_p7(spark, sf_dir))


def p7_char_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with sizes in characters, which SQL can count too."""
    sizes = mix.character_sizes(_table(spark, sf_dir, "documents"))
    report = mix.shares(sizes, mix.rates(sizes, _table(spark, sf_dir, "mix_targets")))
    digits = {c: F.round(c, 6) for c in ("rate", "shortfall", "uncapped_size", "actual_share")}
    return report.withColumns(digits)


def p7_char_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mix.character_sizes(_table(spark, sf_dir, "documents"))
    return mix.mix(sizes, mix.rates(sizes, _table(spark, sf_dir, "mix_targets")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.found(_documents(spark, sf_dir, "text"))


def p8_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measured(_documents(spark, sf_dir, "text"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated share of every document."""
    shares = repetition.measured(_documents(spark, sf_dir, "text"))
    return shares.select("doc_id", "n_letters", F.round("repeated_share", 9).alias("repeated_share"))


def p8_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.bands(repetition.measured(_documents(spark, sf_dir, "text"), share=False))


def queries() -> dict[str, Query]:
    every = (
        p1_distinct,
        p1_runs,
        p1_run_lengths,
        p5_percentiles,
        p5_select,
        p6_ids,
        p6_decoded,
        p7_mix,
        p7_shares,
        p7_char_shares,
        p7_char_mix,
        p8_found,
        p8_measures,
        p8_shares,
        p8_bands,
    )
    return {f.__name__: f for f in every}


# Plans 8 to 10: label columns and identifier, as text of the oracle.
_DISTINCT = {8: (["env"], "client_key"), 9: (["env", "status"], "client_addr"), 10: (["tenant"], "account_no")}
_QUANTILE = {5: (["route"], "value"), 6: (["env", "status"], "value"), 7: (["tenant"], "bytes_out")}


def _key(by: list[str]) -> str:
    return " || '|' || ".join(f"coalesce({c}, '<null>')" for c in by) or "''"


def _distinct_sql() -> str:
    parts = []
    for plan_id, (by, field) in _DISTINCT.items():
        for mask in range(1 << len(by)):
            kept = [c for i, c in enumerate(by) if mask >> i & 1]
            for day in ("strftime(ts, '%Y-%m-%d')", "'all'"):
                groups = ", ".join([*kept, *([day] if "ts" in day else [])])
                parts.append(
                    f"SELECT {plan_id} AS plan_id, '{'|'.join(kept)}' AS by_labels, {_key(kept)} AS by_key, "
                    f"{day} AS on_day, count(DISTINCT {field}) AS n_distinct FROM usage_samples "
                    f"WHERE {field} IS NOT NULL" + (f" GROUP BY {groups}" if groups else " HAVING count(*) > 0")
                )
    union = " UNION ALL ".join(parts)
    n = "CAST(n_distinct AS DOUBLE)"
    return f"SELECT *, {n} * ({n} - 1) / 36893488147419103232.0::DOUBLE AS error_bound FROM ({union})"


def _run_lengths_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT {plan_id} AS plan_id, strftime(ts, '%Y-%m-%d') AS on_day, {_key(by)} AS by_key, "
        f"count(DISTINCT {field}) AS n_distinct FROM usage_samples WHERE {field} IS NOT NULL "
        f"GROUP BY {', '.join(by)}, strftime(ts, '%Y-%m-%d')"
        for plan_id, (by, field) in _DISTINCT.items()
    )


def _quantile_sql() -> str:
    parts = []
    for plan_id, (by, field) in _QUANTILE.items():
        for day in ("strftime(ts, '%Y-%m-%d')", "'all'"):
            groups = ", ".join([*by, *([day] if "ts" in day else [])])
            rank = " , ".join(
                f"max(CASE WHEN r = (n * {p} + 999) // 1000 THEN v END) AS {name}"
                for p, name in zip(percentiles.PERMILLES, percentiles.NAMES)
            )
            parts.append(
                f"SELECT {plan_id} AS plan_id, by_key, on_day, max(n) AS n_values, {rank}, 0 AS rank_error FROM ("
                f"SELECT {_key(by)} AS by_key, {day} AS on_day, {', '.join(f'{c} AS g{i}' for i, c in enumerate(by))}, "
                f"{field}::DOUBLE AS v, row_number() OVER (PARTITION BY {groups} ORDER BY {field}::DOUBLE) AS r, "
                f"count(*) OVER (PARTITION BY {groups}) AS n FROM usage_samples "
                f"WHERE {field} IS NOT NULL AND NOT isnan({field}::DOUBLE)"
                f") GROUP BY by_key, on_day, {', '.join(f'g{i}' for i in range(len(by)))}"
            )
    return " UNION ALL ".join(parts)


_BLANKS = re.sub(r"\\u(....)", r"\\x{\1}", mix._BLANKS)
_MIX_SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(n_chars, 0)::BIGINT AS size,
    lower(regexp_replace(source, '{_BLANKS}', '', 'g')) AS source FROM documents
), targets AS (
  SELECT mix_name, lower(regexp_replace(source, '{_BLANKS}', '', 'g')) AS source, target_share, max_repeats
  FROM mix_targets
), totals AS (SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_tokens FROM docs GROUP BY 1),
known AS (
  SELECT mix_name, source, target_share, max_repeats, coalesce(n_docs, 0) AS n_docs,
    coalesce(source_tokens, 0)::BIGINT AS source_tokens FROM targets LEFT JOIN totals USING (source)
), sized AS (SELECT *, sum(source_tokens) OVER (PARTITION BY mix_name)::DOUBLE AS size FROM known),
rated AS (
  SELECT *, CASE WHEN source_tokens > 0 THEN least(target_share * size / source_tokens, max_repeats) ELSE 0.0 END::DOUBLE AS rate
  FROM sized
), chosen AS (
  SELECT mix_name, doc_id, docs.source, docs.size AS n, rate,
    ('0x' || substr(md5(mix_name || '|' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS chance
  FROM docs JOIN rated USING (source)
), emitted AS (
  SELECT mix_name, doc_id, source, n::INTEGER AS n_tokens,
    (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM chosen
)
"""

_SHARES_SQL = (
    _MIX_SQL
    + """, sums AS (
  SELECT mix_name, source, sum(n_tokens::BIGINT * copies)::BIGINT AS mix_tokens, sum(copies)::BIGINT AS mix_docs,
    max(copies) AS most_repeats FROM emitted WHERE copies > 0 GROUP BY 1, 2
), report AS (
  SELECT mix_name, source, n_docs, source_tokens, target_share, max_repeats, rate,
    greatest(target_share * size - rate * source_tokens, 0.0) AS shortfall,
    min(CASE WHEN target_share > 0 THEN max_repeats * source_tokens / target_share END)
      OVER (PARTITION BY mix_name) AS uncapped_size,
    coalesce(most_repeats, 0) AS most_repeats, coalesce(mix_docs, 0) AS mix_docs, coalesce(mix_tokens, 0) AS mix_tokens
  FROM rated LEFT JOIN sums USING (mix_name, source)
)
SELECT * REPLACE (round(rate, 6) AS rate, round(shortfall, 6) AS shortfall, round(uncapped_size, 6) AS uncapped_size),
  round(CASE WHEN sum(mix_tokens) OVER w > 0 THEN mix_tokens / sum(mix_tokens) OVER w ELSE 0.0 END, 6)::DOUBLE AS actual_share
FROM report WINDOW w AS (PARTITION BY mix_name)"""
)

# Units as in ``repetition.splitter``; a run is complete at 60 points, and the units
# whose first point lies within the 60 points from a unit's first make its run.
_UNSPACED_CLASS = f"[{repetition.UNSPACED}]"
_SPOILT = r"[\x{00C2}-\x{00DF}][\x{00A0}-\x{00BF}]"
_WORD = f"(?:{_SPOILT}|[^{repetition.UNSPACED}\\P{{L}}]|[^{repetition.UNSPACED}\\P{{N}}])+"
_REPEATED_SQL = rf"""
WITH clean AS (
  SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\p{{Cf}}\p{{M}}\x00-\x08\x0e-\x1f\x7f-\x9f]+', '', 'g'),
    '\p{{Nd}}+(?:[.,:/\-]\p{{Nd}}+)*', '0', 'g') AS t FROM documents
), listed AS (
  SELECT doc_id, regexp_extract_all(t, '{_UNSPACED_CLASS}|{_WORD}') AS us FROM clean
), units AS (
  SELECT doc_id, unnest(generate_series(1, len(us))) AS i, lower(unnest(us)) AS u FROM listed
), weighed AS (
  SELECT doc_id, i, u, length(regexp_replace(u, '[^\p{{L}}]', '', 'g')) AS letters,
    CASE WHEN regexp_full_match(u, '{_UNSPACED_CLASS}') THEN 5 ELSE 12 END AS points FROM units
), placed AS (
  SELECT *, sum(points) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - points AS s FROM weighed
), runs AS (
  SELECT *, string_agg(u, ' ') OVER r AS run, max(s + points) OVER r AS stop FROM placed
  WINDOW r AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 59 FOLLOWING)
), again AS (
  SELECT *, CASE WHEN stop - s >= 60 AND i > min(i) OVER (PARTITION BY doc_id, run, stop - s >= 60) THEN stop END AS marks
  FROM runs
), covered AS (
  SELECT doc_id, letters, coalesce(max(marks) OVER (PARTITION BY doc_id ORDER BY i), 0) > s AS repeated FROM again
), shares AS (
  SELECT doc_id, sum(letters)::BIGINT AS n_letters, coalesce(sum(letters) FILTER (repeated), 0) AS again
  FROM covered GROUP BY 1
)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_distinct": _distinct_sql(),
        "p1_run_lengths": _run_lengths_sql(),
        "p5_percentiles": _quantile_sql(),
        "p5_select": _quantile_sql(),
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_char_shares": _SHARES_SQL,
        "p7_char_mix": _MIX_SQL
        + "SELECT mix_name, doc_id, unnest(generate_series(1, copies))::INTEGER AS copy_no, source, n_tokens "
        "FROM emitted WHERE copies > 0",
        "p8_found": _REPEATED_SQL + "SELECT doc_id FROM shares WHERE n_letters > 0 AND again / n_letters > 1.0 / 3",
        "p8_shares": _REPEATED_SQL
        + "SELECT doc_id, coalesce(n_letters, 0) AS n_letters, "
        "round(coalesce(again / nullif(n_letters, 0), 0), 9)::DOUBLE AS repeated_share FROM documents LEFT JOIN shares USING (doc_id)",
    }
