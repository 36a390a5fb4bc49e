"""The driver's contract."""

import __spark_entry__


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
