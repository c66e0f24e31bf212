"""Every core query against its SQL, and the driver's entry points."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same, connect
from tsq import metric_queries, queries


@pytest.mark.parametrize("name", sorted(metric_queries.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert_same(got, connect(sf_dir).execute(queries.oracle_sql()[name]).df())


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p3_found", "p4_found"} <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["event_type", "user_id", "ts", "value"] and df.count() > 0
