"""Aggregation over labels, in two steps: each series to one value a window, then the
values of a label group to one.

Both steps reduce before their shuffle.  Standard deviation and variance are those of
the whole population.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsq.operators.grid import floor_div, order_of
from tsq.timemath import Duration, Instant, from_micros, micros

AGGREGATORS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "stddev": F.stddev_pop,
    "stdvar": F.var_pop,
    "group": lambda v: F.max(F.when(v.isNotNull(), F.lit(1.0))),
}
WINDOW_OPS = ("first", "sum", "avg", "min", "max", "count")


def bucket(time: Column, kind, size: Duration, origin: Instant) -> Column:
    """Start of the window of ``size`` that holds a time, windows aligned to ``origin``."""
    us, start = size.millis * 1000, origin.millis * 1000
    return from_micros(floor_div(micros(time, kind) - start, us) * us + start, kind)


def per_window(
    df: DataFrame,
    labels: Sequence[str],
    time: str,
    value: str,
    op: str = "first",
    size: Duration | None = None,
    origin: Instant = Instant(0),
    tie: str | None = None,
) -> DataFrame:
    """(labels, window_start, value): each series reduced to one value a window; without
    a size the window is the whole range and window_start is left out."""
    if op not in WINDOW_OPS:
        raise ValueError(f"unknown window operator {op}")
    keys: list = list(labels)
    if size is not None:
        keys.append(bucket(F.col(time), df.schema[time].dataType, size, origin).alias("window_start"))
    v = F.col(value)
    reduced = F.min_by(v, F.when(v.isNotNull(), order_of(df, time, tie))) if op == "first" else AGGREGATORS[op](v)
    return df.groupBy(*keys).agg(reduced.alias(value))


def over_labels(df: DataFrame, name: str, by: Sequence[str], value: str) -> DataFrame:
    """(window_start, by, value): the values of each label group and window aggregated."""
    window = ["window_start"] if "window_start" in df.columns else []
    return df.groupBy(*window, *by).agg(AGGREGATORS[name](F.col(value)).alias(value))
