"""Every query with SQL against DuckDB, on the odd cases and on empty tables."""

import pytest

from longloom.llm import catalog
from llm_helpers import oracle_rows, spark_rows

SQL = sorted(catalog.ORACLE)


@pytest.mark.parametrize("name", SQL)
def test_odd_cases(spark, odd_dir, name):
    assert spark_rows(catalog.QUERIES[name](spark, odd_dir)) == oracle_rows(catalog.ORACLE[name], odd_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = catalog.QUERIES[name](spark, empty_dir).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op8") else [])


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 14))
