"""Metrics from Python rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tsq.errors import SchemaMismatch
from tsq.schema import GridMeta, MetricSchema
from tsq.types import label_value


def long_rows(
    spark: SparkSession, schema: MetricSchema, rows: Iterable[Mapping[str, Any]], time: str = "ts"
) -> DataFrame:
    """Samples: mappings of label, time and field names; missing ones are NULL."""
    kind = schema.spark_schema(time, T.TimestampNTZType(), packed=False)
    return spark.createDataFrame([_row(schema, kind, r) for r in rows], kind)


def packed_rows(
    spark: SparkSession,
    schema: MetricSchema,
    grid: GridMeta,
    rows: Iterable[Mapping[str, Any]],
    time: str = "chunk_start",
) -> DataFrame:
    """Series of one chunk each: a field not given is a list of ``width`` NULLs, and a
    list has exactly ``width`` samples.  Equal label sets stay rows of their own."""
    kind = schema.spark_schema(time, T.TimestampNTZType(), packed=True)
    start = datetime(1970, 1, 1) + timedelta(milliseconds=grid.start_at.millis)
    out = []
    for r in rows:
        row = dict(r)
        row.setdefault(time, start)
        for f in schema.field_names:
            row.setdefault(f, [None] * grid.width)
            if row[f] is not None and len(row[f]) != grid.width:
                raise SchemaMismatch(f"field {f} has {len(row[f])} samples, the chunk's width is {grid.width}")
        out.append(_row(schema, kind, row))
    return spark.createDataFrame(out, kind)


def _row(schema: MetricSchema, kind: T.StructType, row: Mapping[str, Any]) -> tuple:
    if unknown := set(row) - set(kind.names):
        raise SchemaMismatch(f"unknown columns: {sorted(unknown)}")
    values = []
    for name in kind.names:
        label = schema.label(name)
        value = row.get(name)
        if label is not None:
            typed = label_value(label.type, value)
            value = None if typed is None else typed.value
        values.append(value)
    return tuple(values)
