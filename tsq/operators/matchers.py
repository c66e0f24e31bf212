"""Label matchers as filter columns, with two-valued NULL semantics.

    =        NULL rows dropped (kept for = NULL)
    !=       NULL rows kept (dropped for != NULL)
    =~  !~   NULL rows dropped by both; unanchored
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsq.plans.logical import EQUAL, NOT_EQUAL, REGEX, Matcher, MatcherOp
from tsq.plans.promql import java_pattern


def predicate(column: Column, op: MatcherOp) -> Column:
    """One matcher; literals reach the Parquet scan, regexes stay a filter above it."""
    if op.op in (EQUAL, NOT_EQUAL):
        if op.operand is None:
            return column.isNull() if op.op == EQUAL else column.isNotNull()
        same = column.eqNullSafe(op.operand.column())
        return same if op.op == EQUAL else ~same
    matched = column.rlike(java_pattern(op.operand))
    return matched if op.op == REGEX else ~matched


def conjunction(matchers: Iterable[Matcher]) -> Column | None:
    """All matchers; several on one label all hold.  None where there are none."""
    parts = [predicate(F.col(f"`{m.name}`"), m.op) for m in matchers]
    return reduce(lambda a, b: a & b, parts) if parts else None
