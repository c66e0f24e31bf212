"""The queries of the subpackage against their SQL, and its independence."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from tests.oracle import assert_same, connect


WITH_SQL = (
    "p1_distinct p1_run_lengths p5_percentiles p5_select p6_decoded p7_char_shares p7_char_mix p8_found p8_shares".split()
)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_matches_sql(spark, sf_dir, name):
    from tsq.llm import queries

    got = queries.queries()[name](spark, sf_dir).toPandas()
    assert_same(got, connect(sf_dir).execute(queries.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["p1_runs", "p6_ids", "p7_mix", "p7_shares", "p8_measures", "p8_bands"])
def test_query_runs(spark, sf_dir, name):
    from tsq.llm import queries

    df = queries.queries()[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_nothing_else_imports_the_subpackage():
    code = "import sys; sys.modules['tsq.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries())[-1])"
    root = os.path.dirname(os.path.dirname(os.path.dirname(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and "p1_distinct" not in out.stdout, out.stderr
