"""Every query of the library against its SQL."""

import pytest

from panelwright.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query_matches_sql(spark, sf, duck, rows_of, name):
    assert rows_of(q.QUERIES[name](spark, sf)) == rows_of(duck.sql(q.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
