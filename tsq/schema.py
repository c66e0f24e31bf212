"""Declared schemas of metrics: labels, fields, index hints and the time grid."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tsq.errors import SchemaMismatch
from tsq.timemath import Duration, Instant
from tsq.types import FIELD_TYPES, LABEL_TYPES, TYPE_KEY


@dataclass(frozen=True)
class Index:
    """A hint for data skipping: ``inverted``, or ``sparse`` with rows per block."""

    kind: str
    block_size: int | None = None

    def __post_init__(self):
        if self.kind not in ("inverted", "sparse"):
            raise SchemaMismatch(f"unknown index kind {self.kind}")


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str


@dataclass(frozen=True)
class MetricSchema:
    """Labels and fields by position, and an index hint for some labels by name.  A
    label without a hint is stored and matched like any other."""

    labels: tuple[ColumnDef, ...]
    fields: tuple[ColumnDef, ...]
    index: dict[str, Index] = field(default_factory=dict)

    @classmethod
    def of(cls, labels: dict[str, str], fields: dict[str, str], index: dict[str, Index] | None = None) -> MetricSchema:
        return cls(
            tuple(ColumnDef(*x) for x in labels.items()), tuple(ColumnDef(*x) for x in fields.items()), index or {}
        )

    def __post_init__(self):
        for c, known in [(c, LABEL_TYPES) for c in self.labels] + [(c, FIELD_TYPES) for c in self.fields]:
            if c.type not in known:
                raise SchemaMismatch(f"column {c.name} has unknown type {c.type}")
        names = [c.name for c in (*self.labels, *self.fields)]
        if len(set(names)) != len(names):
            raise SchemaMismatch(f"column names repeat: {names}")
        if unknown := set(self.index) - set(self.label_names):
            raise SchemaMismatch(f"index on unknown labels: {sorted(unknown)}")

    @property
    def label_names(self) -> list[str]:
        return [c.name for c in self.labels]

    @property
    def field_names(self) -> list[str]:
        return [c.name for c in self.fields]

    def label(self, name: str) -> ColumnDef | None:
        return next((c for c in self.labels if c.name == name), None)

    def field(self, name: str) -> ColumnDef | None:
        return next((c for c in self.fields if c.name == name), None)

    def spark_schema(self, time: str, time_type: T.DataType, packed: bool) -> T.StructType:
        """The row type of a batch: labels, time, then fields (lists in packed form)."""
        parts = [T.StructField(c.name, LABEL_TYPES[c.type], True, {TYPE_KEY: c.type}) for c in self.labels]
        parts.append(T.StructField(time, time_type))
        for c in self.fields:
            kind = FIELD_TYPES[c.type]
            parts.append(T.StructField(c.name, T.ArrayType(kind) if packed else kind, True, {TYPE_KEY: c.type}))
        return T.StructType(parts)

    def validate(self, df: DataFrame, time: str, packed: bool) -> None:
        """Every declared column is there with its type; other columns are ignored."""
        have = {f.name: f.dataType for f in df.schema.fields}
        repeated = {x for x in df.columns if df.columns.count(x) > 1}
        for c in (*self.labels, *self.fields):
            if c.name in repeated:
                raise SchemaMismatch(f"column {c.name} is there more than once")
            want = LABEL_TYPES.get(c.type) if c in self.labels else FIELD_TYPES[c.type]
            got = have.get(c.name)
            if c in self.fields and packed:
                got = got.elementType if isinstance(got, T.ArrayType) else None
            if got != want:
                raise SchemaMismatch(f"column {c.name}: declared {c.type} ({want}), found {have.get(c.name)}")
        if not isinstance(have.get(time), (T.TimestampType, T.TimestampNTZType)):
            raise SchemaMismatch(f"time column {time} is {have.get(time)}")


@dataclass(frozen=True)
class GridMeta:
    """The time grid: slot i of a chunk covers start + i * unit up to the next slot; a
    packed row holds ``width`` slots."""

    start_at: Instant
    unit: Duration
    width: int = 1

    def __post_init__(self):
        if self.unit.millis <= 0 or self.width <= 0:
            raise SchemaMismatch("a grid needs a positive unit and width")
