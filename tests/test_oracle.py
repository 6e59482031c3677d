"""Every registered query with an oracle agrees with DuckDB on sf0.001."""

import sys

import pytest

sys.path.insert(0, ".")

import __spark_entry__ as entry  # noqa: E402
from tools.oracle_check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
SKIP_SLOW: set[str] = set()


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SKIP_SLOW))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    ok, msg = compare(sdf.toPandas(), duck.execute(ORACLES[name]).df())
    assert ok, msg


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "macro_f1" in df.columns
