"""Instants, durations and time ranges in milliseconds, and their Spark columns.

Division truncates towards zero.  Columns may be ``timestamp_ntz`` (read as UTC,
whatever the session's zone) or ``timestamp``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _div(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


@dataclass(frozen=True, order=True)
class Duration:
    millis: int

    @classmethod
    def from_secs(cls, secs: int) -> Duration:
        return cls(secs * 1000)

    @classmethod
    def of(cls, value: Duration | timedelta | int) -> Duration:
        """A duration from a timedelta or milliseconds."""
        if isinstance(value, timedelta):
            return cls(value // timedelta(milliseconds=1))
        return value if isinstance(value, Duration) else cls(value)

    def as_millis(self) -> int:
        return self.millis

    def __mul__(self, n: int) -> Duration:
        return Duration(self.millis * n)

    __rmul__ = __mul__

    def __truediv__(self, other: Duration | int) -> Duration | int:
        if isinstance(other, Duration):
            return _div(self.millis, other.millis)
        return Duration(_div(self.millis, other))


SECOND = Duration(1000)


@dataclass(frozen=True, order=True)
class Instant:
    millis: int = 0

    @classmethod
    def now(cls) -> Instant:
        return cls(time.time_ns() // 1_000_000)

    @classmethod
    def from_millis(cls, millis: int) -> Instant:
        return cls(millis)

    @classmethod
    def of(cls, value: Instant | datetime | str | int) -> Instant:
        """An instant from a datetime or ISO text (UTC without a zone) or milliseconds."""
        if isinstance(value, str):
            value = datetime.fromisoformat(value)
        if isinstance(value, datetime):
            aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
            return cls((aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(milliseconds=1))
        return value if isinstance(value, Instant) else cls(value)

    def as_millis(self) -> int:
        return self.millis

    def __add__(self, d: Duration) -> Instant:
        return Instant(self.millis + d.millis)

    def __sub__(self, other: Instant | Duration) -> Instant | Duration:
        if isinstance(other, Instant):
            return Duration(self.millis - other.millis)
        return Instant(self.millis - other.millis)

    def __truediv__(self, d: Duration) -> int:
        return _div(self.millis, d.millis)

    def __str__(self) -> str:
        return (datetime(1970, 1, 1) + timedelta(milliseconds=self.millis)).isoformat(sep=" ") + " UTC"

    def column(self, kind: T.DataType) -> Column:
        """A literal of a time column's type."""
        at = datetime(1970, 1, 1) + timedelta(milliseconds=self.millis)
        if isinstance(kind, T.TimestampNTZType):
            return F.lit(at.isoformat(sep=" ")).cast(kind)
        return F.timestamp_millis(F.lit(self.millis))


EPOCH = Instant(0)


@dataclass(frozen=True)
class TimeRange:
    """start <= t < end; a missing bound is open."""

    start: Instant | None = None
    end: Instant | None = None

    def is_empty(self) -> bool:
        return self.start is not None and self.end is not None and self.start >= self.end

    def __and__(self, other: TimeRange) -> TimeRange:
        starts = [x for x in (self.start, other.start) if x is not None]
        ends = [x for x in (self.end, other.end) if x is not None]
        return TimeRange(max(starts, default=None), min(ends, default=None))

    def predicate(self, column: Column, kind: T.DataType) -> Column | None:
        """The range as a filter, None where both bounds are open."""
        if self.is_empty():
            return F.lit(False)
        parts = []
        if self.start is not None:
            parts.append(column >= self.start.column(kind))
        if self.end is not None:
            parts.append(column < self.end.column(kind))
        return (parts[0] & parts[1]) if len(parts) == 2 else parts[0] if parts else None


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since the epoch."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(column)
    days = F.datediff(column.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(column) * 3600 + F.minute(column) * 60
    rest = (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    return (days * 86_400 + seconds) * 1_000_000 + rest


def from_micros(us: Column, kind: T.DataType) -> Column:
    """The time so many microseconds after the epoch."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(us)
    return F.lit("1970-01-01 00:00:00").cast(kind) + F.expr("INTERVAL '0.000001' SECOND") * us
