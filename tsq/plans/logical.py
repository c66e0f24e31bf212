"""The logical plan: scans, calls, aggregates and literals."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

from tsq.timemath import Duration, TimeRange
from tsq.types import LabelValue

EQUAL, NOT_EQUAL, REGEX, NOT_REGEX = "=", "!=", "=~", "!~"


@dataclass(frozen=True)
class MatcherOp:
    """An operator and its operand: a label value, None for NULL, or a pattern's text."""

    op: str
    operand: LabelValue | str | None = None

    @property
    def positive(self) -> bool:
        return self.op in (EQUAL, REGEX)

    @property
    def is_regex(self) -> bool:
        return self.op in (REGEX, NOT_REGEX)


@dataclass(frozen=True)
class Matcher:
    name: str
    op: MatcherOp


@dataclass(frozen=True)
class Projection:
    """Names of labels and fields; None is all of them."""

    labels: tuple[str, ...] | None = None
    fields: tuple[str, ...] | None = None

    def insert(self, kind: str, name: str) -> Projection:
        """With one more ``label`` or ``field``, if it is not there."""
        return self.append(Projection((name,), ()) if kind == "label" else Projection((), (name,)))

    def append(self, other: Projection) -> Projection:
        """The union of both, in order; all stays all."""
        return Projection(_union(self.labels, other.labels), _union(self.fields, other.fields))


def _union(a: tuple[str, ...] | None, b: tuple[str, ...] | None) -> tuple[str, ...] | None:
    if a is None or b is None:
        return None
    return tuple(dict.fromkeys((*a, *b)))


@dataclass(frozen=True)
class Scan:
    """Two scans are equal whatever their time range."""

    resource: str
    matchers: tuple[Matcher, ...] = ()
    range: TimeRange = field(default=TimeRange(), compare=False)
    projection: Projection = Projection(None, ("value",))


@dataclass(frozen=True)
class Literal:
    value: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple["Logical", ...]


@dataclass(frozen=True)
class Window:
    """How a series is reduced to one value a window; size None is the whole range."""

    op: str = "first"
    size: Duration | None = None


WITH, WITHOUT = "with", "without"


@dataclass(frozen=True)
class Aggregate:
    name: str
    action: str
    by: tuple[str, ...]
    args: tuple["Logical", ...]
    window: Window = Window()


Logical = Union[Scan, Call, Aggregate, Literal]
