"""Per-key results where a few keys hold most records (p2).

Value-frequency compression: rows are grouped by key and value before key, so a hot
key is spread over the tasks by its values; the (key, value, n) rows are then grouped
by key and frequency, and last by key.  Every step counts before it shuffles, so the
rows of one key that reach a task are at most one for each map task and frequency.

Results are exact: rows, values, distinct values and the most frequent value (the
least of several) come from the weighted values.

Defined results: a missing label is a key like any other; a NULL value counts as a row
but not as a value; NaN is one value, greater than all others; repeated rows count; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def label_text(rows: DataFrame, name: str) -> Column:
    """A label as text, as stored; addresses in hexadecimal."""
    if isinstance(rows.schema[name].dataType, T.BinaryType):
        return F.hex(name)
    return F.col(name).cast("string")


def by_key(values: Column) -> Column:
    """Label values joined by ``|``, ``<null>`` for a missing one."""
    return F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("<null>"))), "|")


def value_frequencies(rows: DataFrame, plans: Sequence[dict]) -> DataFrame:
    """(plan_id, by_values, value, n): how often each key of each plan has each value.
    All plans share one scan; a plan has plan_id, by and field."""
    cells = [
        F.struct(
            F.lit(p["plan_id"]).cast("int").alias("plan_id"),
            F.array(*[label_text(rows, c) for c in p["by"]]).cast("array<string>").alias("by_values"),
            F.col(p["field"]).cast("double").alias("value"),
        )
        for p in plans
    ]
    spread = rows.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    return spread.groupBy("plan_id", "by_values", "value").agg(F.count("*").alias("n"))


def key_results(frequencies: DataFrame) -> DataFrame:
    """(plan_id, by_values, n_rows, n_values, n_distinct, mode_value, mode_n)."""
    key = ["plan_id", "by_values"]
    present = F.col("value").isNotNull()
    levels = frequencies.groupBy(*key, "n").agg(
        F.count(F.when(present, 1)).alias("distinct_at"),
        F.count(F.when(~present, 1)).alias("null_at"),
        F.min("value").alias("least"),
    )
    in_values = F.when(F.col("distinct_at") > 0, F.col("n"))
    return levels.groupBy(*key).agg(
        F.sum(F.col("n") * (F.col("distinct_at") + F.col("null_at"))).alias("n_rows"),
        F.sum(F.col("n") * F.col("distinct_at")).alias("n_values"),
        F.sum("distinct_at").alias("n_distinct"),
        F.max_by("least", in_values).alias("mode_value"),
        F.coalesce(F.max(in_values), F.lit(0)).alias("mode_n"),
    )


def hot_keys(results: DataFrame, share: float = 0.02) -> DataFrame:
    """Keys that hold more than ``share`` of all rows of their plan."""
    totals = results.groupBy("plan_id").agg(F.sum("n_rows").alias("total"))
    # One row for each plan: bounded by the fixed list of plans.
    hot = results.join(F.broadcast(totals), "plan_id").where(F.col("n_rows") > F.col("total") * F.lit(share))
    return hot.select("plan_id", by_key(F.col("by_values")).alias("by_key"), "n_rows", "total")
