"""Aggregate plans stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_plans(plans: DataFrame, schema: DataFrame) -> list[dict]:
    """The aggregate plans of a resource's schema, in order of plan_id: plan_id,
    resource, agg_name, by (label names), field, window_ms.

    ``with`` groups by the listed labels, ``without`` by the resource's other labels in
    their order.  Both tables hold a few rows, the same at every scale."""
    labels: dict[str, list[str]] = {}
    rows = schema.where("column_role = 'label'").select("resource", "column_name", "ordinal").collect()
    for r in sorted(rows, key=lambda r: r["ordinal"]):
        labels.setdefault(r["resource"], []).append(r["column_name"])
    return [
        {
            "plan_id": r["plan_id"],
            "resource": r["resource"],
            "agg_name": r["agg_name"],
            "by": group_labels(labels.get(r["resource"], []), r["agg_action"], r["by_labels"] or []),
            "field": r["field_name"],
            "window_ms": r["window_size_ms"],
        }
        for r in plans.orderBy(F.col("plan_id")).collect()
    ]


def group_labels(labels: list[str], action: str, listed: list[str]) -> list[str]:
    """The labels to group by: those listed, or all the others."""
    if action == "with":
        return list(listed)
    return [x for x in labels if x not in listed]
