import pytest

import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import os

    if not os.path.isdir(entry.SMOKE_DIR):
        pytest.skip("no test data here")
    assert entry.entry(spark).count() >= 0
