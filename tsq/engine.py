"""The engine: PromQL text or a logical plan in, a lazy DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tsq.catalog import Catalog
from tsq.errors import InvalidRegex, NoColumn, NoSupportRegex, ResourceNotExists
from tsq.plans import analyze as analysis
from tsq.plans import lower as lowering
from tsq.plans.logical import EQUAL, NOT_EQUAL, Aggregate, Logical, Matcher, MatcherOp, Projection, Scan, Window
from tsq.plans.promql import java_pattern, parse
from tsq.timemath import Duration, Instant, TimeRange
from tsq.types import label_value


class Engine:
    """Queries over the tables of a catalog.  Nothing runs before an action."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog if catalog is not None else Catalog()

    def check_regex(self, pattern: str) -> str:
        """The Java pattern, compiled once so that a wrong one fails at parsing."""
        java = java_pattern(pattern)
        try:
            self.spark._jvm.java.util.regex.Pattern.compile(java)
        except Exception as e:
            raise InvalidRegex(str(e).split("\n")[0]) from e
        return java

    def parse(self, text: str, at: Instant | datetime | str | None = None) -> Logical:
        return parse(text, Instant.of(at) if at is not None else None, self.check_regex)

    def query(
        self,
        text: str,
        at: Instant | datetime | str | None = None,
        window: timedelta | Duration | None = None,
        limit: int | None = None,
    ) -> DataFrame:
        """The result of a query evaluated at ``at`` (default now).

        ``window`` makes the windows of an outermost aggregation that long (else one
        window is the whole range); ``limit`` keeps the first rows in the order of all
        columns."""
        plan = self.parse(text, at)
        if window is not None and isinstance(plan, Aggregate):
            plan = replace(plan, window=Window("first", Duration.of(window)))
        return self.run(plan, limit)

    def run(self, plan: Logical, limit: int | None = None) -> DataFrame:
        """The result of a logical plan."""
        df = lowering.lower(analysis.analyze(plan, self.catalog))
        return df if limit is None else limited(df, limit)

    def matcher(self, resource: str, name: str, op: str, operand: Any) -> Matcher:
        """A typed matcher: the operand is a Python value of the label's type, None for
        NULL, or a pattern."""
        table = self.catalog.get(resource)
        if table is None:
            raise ResourceNotExists(resource)
        label = table.schema.label(name)
        if label is None:
            raise NoColumn("match", resource, name)
        if op in (EQUAL, NOT_EQUAL):
            return Matcher(name, MatcherOp(op, label_value(label.type, operand)))
        if label.type != "string":
            raise NoSupportRegex(label.type, name, resource)
        self.check_regex(operand)
        return Matcher(name, MatcherOp(op, operand))

    def plan_scan(
        self,
        resource: str,
        matchers: Sequence[tuple[str, str, Any]] = (),
        start: Instant | datetime | str | None = None,
        end: Instant | datetime | str | None = None,
        labels: Sequence[str] | None = None,
        fields: Sequence[str] | None = None,
    ) -> Scan:
        """A scan by the programmatic API; missing lists are all columns."""
        wanted = TimeRange(
            Instant.of(start) if start is not None else None, Instant.of(end) if end is not None else None
        )
        projection = Projection(
            None if labels is None else tuple(labels), None if fields is None else tuple(fields)
        )
        return Scan(resource, tuple(self.matcher(resource, *m) for m in matchers), wanted, projection)

    def scan(self, resource: str, *args, limit: int | None = None, **kwargs) -> DataFrame:
        """``plan_scan`` as a DataFrame (labels, ts, fields)."""
        return self.run(self.plan_scan(resource, *args, **kwargs), limit)

    def scan_packed(self, resource: str, *args, **kwargs) -> DataFrame:
        """A packed table as it is stored, lists cut to the range."""
        node = analysis.resolve_scan(self.plan_scan(resource, *args, **kwargs), self.catalog)
        return lowering.lower_packed(node)


def limited(df: DataFrame, limit: int, order: Sequence[str] | None = None) -> DataFrame:
    """The first rows in a fixed order: exact and global."""
    return df.orderBy(*(order or df.columns)).limit(limit)
