import os

import pytest

import __spark_entry__ as entry


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="no test tables here")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sql_is_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
