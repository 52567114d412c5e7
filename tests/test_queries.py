from __future__ import annotations

import pytest

from ledgerloom.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", catalogue.SQL)
def test_against_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", catalogue.QUERIES[name], catalogue.SQL[name]) == []
