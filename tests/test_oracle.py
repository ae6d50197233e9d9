"""Every core query that SQL can express, on the smallest tables, against that SQL."""

import pytest

from oriel import queries
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF) == ""
