from __future__ import annotations

import pytest
from compare import duck_rows, spark_rows

from quarry.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, folder, duck, name):
    assert spark_rows(QUERIES[name](spark, folder)) == duck_rows(duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["vec_id", "label", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
