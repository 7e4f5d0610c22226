"""The driver contract."""

from __future__ import annotations

import __spark_entry__


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["id1", "id2", "loss"]
