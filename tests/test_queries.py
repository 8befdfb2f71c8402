"""Every registered query of the library runs, and gives what its SQL gives."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from millrace.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_query_gives_what_its_sql_gives(name, same_as_sql):
    same_as_sql(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in SQL])
def test_query_without_sql_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query(spark):
    assert entry.entry(spark).count() > 0
