"""Catalog, schema and typed rows."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tsq.catalog import Catalog, Table
from tsq.errors import SchemaMismatch, TableExists, TypeMismatch
from tsq.schema import GridMeta, Index, MetricSchema
from tsq.sources.memory import long_rows, packed_rows
from tsq.timemath import Duration, Instant
from tsq.types import FIELD_TYPES, ipv4, ipv6

SCHEMA = MetricSchema.of({"env": "string", "status": "string"}, {"value": "float64"}, {"env": Index("inverted")})
GRID = GridMeta(Instant(0), Duration(1000), 1)


@pytest.fixture
def table(spark):
    return Table("foo.bar.something_used", long_rows(spark, SCHEMA, []), SCHEMA, GRID)


def test_create_get_and_exists(table):
    catalog = Catalog()
    catalog.create_table(table)
    assert catalog.get("foo.bar.something_used") is table
    assert catalog.get("nothing") is None
    with pytest.raises(TableExists, match="already holds a table foo.bar.something_used"):
        catalog.create_table(table)


def test_tags(table):
    catalog = Catalog()
    catalog.create_table(table)
    catalog.tag(table.name, ["a", "b"])
    catalog.tag(table.name, ["a"])
    catalog.tag("unknown", ["a"])
    assert catalog.tables_by_tag("a") == [table.name, table.name]
    assert catalog.tables_by_tag("c") == []


def test_label_without_index_hint_is_kept(spark):
    df = long_rows(spark, SCHEMA, [{"env": "p", "status": "200", "value": 1.0}])
    assert df.first()["status"] == "200"


def test_append_keeps_equal_label_sets(spark, table):
    catalog = Catalog()
    catalog.create_table(table)
    row = {"env": "p", "status": "1", "value": 1.0}
    catalog.append(table.name, long_rows(spark, SCHEMA, [row, row]))
    assert catalog.get(table.name).df.count() == 2


def test_schema_is_checked(spark, table):
    wrong = table.df.withColumn("value", table.df["value"].cast("string"))
    with pytest.raises(SchemaMismatch):
        Catalog().create_table(Table("x", wrong, SCHEMA, GRID))
    twice = table.df.select("*", table.df["env"])
    with pytest.raises(SchemaMismatch):
        Catalog().create_table(Table("x", twice, SCHEMA, GRID))
    extra = table.df.withColumn("other", table.df["env"])
    Catalog().create_table(Table("x", extra, SCHEMA, GRID))


@pytest.mark.parametrize(
    "labels,fields,index",
    [
        ({"a": "uuid"}, {}, {}),
        ({}, {"v": "decimal"}, {}),
        ({"a": "string"}, {"a": "int8"}, {}),
        ({"a": "string"}, {}, {"b": Index("inverted")}),
    ],
)
def test_wrong_schemas(labels, fields, index):
    with pytest.raises(SchemaMismatch):
        MetricSchema.of(labels, fields, index)


def test_all_field_types_make_a_batch(spark):
    schema = MetricSchema.of(
        {k: k for k in ("string", "ipv4", "ipv6", "int", "bool")}, {f"f_{k}": k for k in FIELD_TYPES}
    )
    df = packed_rows(spark, schema, GridMeta(Instant(0), Duration(1), 3), [{"string": "x"}])
    row = df.first()
    assert all(row[f"f_{k}"] == [None] * 3 for k in FIELD_TYPES)
    assert isinstance(df.schema["f_uint64"].dataType.elementType, T.DecimalType)
    schema.validate(df, "chunk_start", packed=True)


def test_row_types(spark):
    schema = MetricSchema.of({"l": "int", "a": "ipv4", "b": "ipv6"}, {"v": "float64"})
    df = long_rows(spark, schema, [{"l": 1, "a": "127.0.0.1", "b": "::1", "v": 2.0}])
    assert bytes(df.first()["a"]) == ipv4("127.0.0.1").value == bytes([127, 0, 0, 1])
    assert bytes(df.first()["b"]) == ipv6("::1").value
    with pytest.raises(TypeMismatch):
        long_rows(spark, schema, [{"l": True}])
    with pytest.raises(SchemaMismatch):
        long_rows(spark, schema, [{"nope": 1}])
    with pytest.raises(SchemaMismatch):
        packed_rows(spark, MetricSchema.of({}, {"v": "int8"}), GridMeta(Instant(0), Duration(1), 3), [{"v": [1]}])
