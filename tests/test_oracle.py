"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

LARGER = "/root/testdata/sf0.01"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        diff = check.compare(df, duck, ORACLE[name])
        if diff == "no rows":  # too few rows for this query: the next larger tables must have some
            diff = check.compare(QUERIES[name](spark, LARGER), check.connect(LARGER), ORACLE[name])
        assert diff is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_returns_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
