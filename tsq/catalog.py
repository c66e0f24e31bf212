"""The catalog: metric tables by name, and tags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tsq.errors import TableExists
from tsq.schema import GridMeta, MetricSchema


@dataclass(frozen=True)
class Table:
    """A registered metric.  ``tie`` orders samples of one time within a slot."""

    name: str
    df: DataFrame
    schema: MetricSchema
    grid: GridMeta
    time: str = "ts"
    packed: bool = False
    tie: str | None = None

    @property
    def time_type(self) -> T.DataType:
        return self.df.schema[self.time].dataType


class Catalog:
    """Names to tables; registering a DataFrame is the ingest."""

    def __init__(self):
        self._tables: dict[str, Table] = {}
        self._tags: dict[str, list[str]] = {}

    def create_table(self, table: Table) -> Table:
        """Registers a table, checked against its schema."""
        if table.name in self._tables:
            raise TableExists(table.name)
        table.schema.validate(table.df, table.time, table.packed)
        self._tables[table.name] = table
        return table

    def get(self, name: str) -> Table | None:
        return self._tables.get(name)

    def append(self, name: str, rows: DataFrame) -> Table:
        """Adds rows of the table's schema; equal label sets are kept apart as rows."""
        old = self._tables[name]
        old.schema.validate(rows, old.time, old.packed)
        columns = [*old.schema.label_names, old.time, *old.schema.field_names, *([old.tie] if old.tie else [])]
        new = old.df.select(*columns).unionByName(rows.select(*columns))
        self._tables[name] = Table(old.name, new, old.schema, old.grid, old.time, old.packed, old.tie)
        return self._tables[name]

    def names(self) -> list[str]:
        return list(self._tables)

    def tag(self, name: str, tags: list[str]) -> None:
        """Tags a table; an unknown table is ignored, a repeated tag is kept twice."""
        if name in self._tables:
            for tag in tags:
                self._tags.setdefault(tag, []).append(name)

    def tables_by_tag(self, tag: str) -> list[str]:
        """Extension: the names that carry a tag, in order of tagging."""
        return list(self._tags.get(tag, []))
