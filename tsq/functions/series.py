"""Functions over lists of samples, and the registry of query functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.errors import TsqError, TypeMismatch


class RateOfBool(TsqError):
    def __init__(self):
        super().__init__("differences need numbers: the field is bool")


def rate(values: Column) -> Column:
    """Differences of neighbours: n - 1 samples for n, NULL where either is NULL, of the
    same element type.  Not per second, and without counter resets."""
    rest = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 2, rest), F.slice(values, 1, rest), lambda later, earlier: later - earlier)


def pad(values: Column, constant) -> Column:
    """NULL samples filled with a constant."""
    return F.transform(values, lambda v: F.coalesce(v, F.lit(constant)))


def slice_range(values: Column, start: int, stop: int | None = None) -> Column:
    """Samples start <= i < stop, counted from 0; to the end without a stop."""
    stop_at = F.size(values) if stop is None else F.least(F.lit(stop), F.size(values))
    return F.slice(values, F.lit(start + 1), F.greatest(stop_at - start, F.lit(0)))


def get(values: Column, i: int) -> Column:
    """Sample i, counted from 0; NULL where it is NULL or out of range."""
    return F.get(values, F.lit(i))


def push(values: Column, sample: Column) -> Column:
    """One more sample at the end; NULL is a sample."""
    return F.array_append(values, sample)


def set_sample(values: Column, i: int, sample) -> Column:
    """Sample i replaced; unchanged where i is out of range."""
    return F.transform(values, lambda v, at: F.when(at == i, F.lit(sample)).otherwise(v))


@dataclass(frozen=True)
class SeriesFunction:
    """A query function: one list of samples in, one out."""

    apply: Callable[[Column], Column]
    check: Callable[[str], None]


def _numeric(kind: str) -> None:
    if kind == "bool":
        raise RateOfBool()


def _number(kind: str) -> None:
    if kind == "bool":
        raise TypeMismatch("pad argument", "number", "bool")


FUNCTIONS: dict[str, SeriesFunction] = {
    "rate": SeriesFunction(rate, _numeric),
    "pad": SeriesFunction(lambda values: pad(values, 0), _number),
}
