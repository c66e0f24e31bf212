"""Label and field types, their Spark types and typed label values."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsq.errors import TypeMismatch

LABEL_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "ipv4": T.BinaryType(),
    "ipv6": T.BinaryType(),
    "int": T.LongType(),
    "bool": T.BooleanType(),
}

# Unsigned types take the next wider signed type, so that differences may be negative.
FIELD_TYPES: dict[str, T.DataType] = {
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "bool": T.BooleanType(),
}

TYPE_KEY = "tsq.type"  # the declared type in a column's metadata


@dataclass(frozen=True)
class LabelValue:
    """A literal of a label type; ``value`` has the Python form of the Spark type."""

    type: str
    value: Any

    def column(self) -> Column:
        return F.lit(self.value).cast(LABEL_TYPES[self.type])


def string(value: str | bytes) -> LabelValue:
    return LabelValue("string", value.decode() if isinstance(value, bytes) else value)


def ipv4(value: str | bytes) -> LabelValue:
    return LabelValue("ipv4", ipaddress.IPv4Address(value).packed)


def ipv6(value: str | bytes) -> LabelValue:
    return LabelValue("ipv6", ipaddress.IPv6Address(value).packed)


def integer(value: int) -> LabelValue:
    return LabelValue("int", int(value))


def boolean(value: bool) -> LabelValue:
    return LabelValue("bool", bool(value))


def label_value(kind: str, value: Any) -> LabelValue | None:
    """A value given for a label of a type; addresses may be text.  None is NULL."""
    if value is None:
        return None
    if isinstance(value, LabelValue):
        if value.type != kind:
            raise TypeMismatch("label", kind, value.type)
        return value
    fits = {"string": (str, bytes), "ipv4": (str, bytes), "ipv6": (str, bytes), "int": (int,), "bool": (bool,)}[kind]
    if not isinstance(value, fits) or (kind == "int" and isinstance(value, bool)):
        raise TypeMismatch("label", kind, type(value).__name__)
    return {"string": string, "ipv4": ipv4, "ipv6": ipv6, "int": integer, "bool": boolean}[kind](value)
