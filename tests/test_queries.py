"""Every query that has SQL gives the same rows in both engines."""

from __future__ import annotations

import pytest
from comparing import SF_DIR, duck_lines, spark_lines

from eventloom.plans.record_queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = spark_lines(QUERIES[name](spark, SF_DIR))
    assert found[1]
    if name in ORACLE_SQL:
        assert found == duck_lines(SF_DIR, ORACLE_SQL[name])
