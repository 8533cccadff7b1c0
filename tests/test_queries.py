"""Every query of the library against DuckDB on the driver's smallest tables."""

import pytest

from tallyframe import queries, round_trips  # noqa: F401

from .compare import duck, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(queries.QUERIES[name](spark, SF))
    wanted, want = duck(SF, queries.ORACLE_SQL[name])
    assert names == wanted
    assert rows == want


def test_entry_has_everything(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    row = entry.entry(spark).first()
    assert row.judged + row.unjudged == row.n
