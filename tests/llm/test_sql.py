"""The queries that SQL can express, side by side with it."""

from __future__ import annotations

import pytest

from cadastra.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    ours, theirs = rows(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])
    assert ours == theirs
