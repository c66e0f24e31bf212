"""Lowering of resolved plans to lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsq.functions.series import FUNCTIONS
from tsq.operators import aggregate as agg
from tsq.operators import grid
from tsq.operators.matchers import conjunction
from tsq.plans.analyze import Resolved, ResolvedAggregate, ResolvedCall, ResolvedScan, labels_of, source
from tsq.timemath import Instant, TimeRange

TIE = "_tie"


def lower_scan(node: ResolvedScan, with_tie: bool = False) -> DataFrame:
    """(labels, ts, fields) in long form: matchers and range below, projection above.

    Rows in packed form are trimmed to the range's slots, then unpacked."""
    table = node.table
    df = _matched(node)
    if table.packed:
        df = grid.trim(df, table.time, node.fields, table.grid, node.scan.range)
        return grid.unpack(df, node.labels, table.time, node.fields, table.grid)
    wanted = node.scan.range.predicate(F.col(table.time), table.time_type)
    if wanted is not None:
        df = df.where(wanted)
    tie = [F.col(table.tie).alias(TIE)] if with_tie and table.tie else []
    return df.select(*node.labels, F.col(table.time).alias("ts"), *node.fields, *tie)


def lower_packed(node: ResolvedScan) -> DataFrame:
    """(labels, chunk_start, lists) of a table in packed form."""
    table = node.table
    df = grid.trim(_matched(node), table.time, node.fields, table.grid, node.scan.range)
    return df.select(*node.labels, F.col(table.time).alias("chunk_start"), *node.fields)


def _matched(node: ResolvedScan) -> DataFrame:
    matched = conjunction(node.scan.matchers)
    return node.table.df if matched is None else node.table.df.where(matched)


def lower(node: Resolved) -> DataFrame:
    if isinstance(node, ResolvedScan):
        return lower_scan(node)
    if isinstance(node, ResolvedCall):
        return _call(node)
    return _aggregate(node)


def _call(node: ResolvedCall) -> DataFrame:
    """A function of each series on its table's grid: (labels, ts, value), samples that
    come out NULL left out."""
    scan = source(node)
    table, labels, value = scan.table, list(labels_of(node)), node.field
    if isinstance(node.child, ResolvedScan):
        child = lower_scan(node.child, with_tie=True)
        tie = TIE if TIE in child.columns else None
    else:
        child, tie = lower(node.child), None
    rows = child.select(*labels, "ts", value, *([tie] if tie else []))
    if node.name == "rate":
        return grid.differences(rows, labels, "ts", value, table.grid, tie)
    packed = grid.pack(rows, labels, "ts", value, table.grid, tie)
    applied = FUNCTIONS[node.name].apply(F.col(value)).cast(packed.schema[value].dataType)
    return grid.unpack(packed.withColumn(value, applied), labels, "chunk_start", [value], table.grid)


def _aggregate(node: ResolvedAggregate) -> DataFrame:
    scan = source(node)
    labels = labels_of(node.child)
    if isinstance(node.child, ResolvedScan):
        rows = lower_scan(node.child, with_tie=True)
    else:
        rows = lower(node.child)
    tie = TIE if TIE in rows.columns else None
    window = node.aggregate.window
    origin = _origin(scan.scan.range, scan)
    reduced = agg.per_window(rows, labels, "ts", node.field, window.op, window.size, origin, tie)
    return agg.over_labels(reduced, node.name, node.by, node.field)


def _origin(wanted: TimeRange, scan: ResolvedScan) -> Instant:
    return wanted.start if wanted.start is not None else scan.table.grid.start_at
