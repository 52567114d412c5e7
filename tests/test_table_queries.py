"""What the registered queries over tables read."""

from __future__ import annotations

import pytest

from ledgerloom.plans import table_queries as Q
from ledgerloom.storage import Shelf


def test_lines_are_summed_once(spark):
    printed = Q._printed(spark, "/root/testdata/sf0.001")
    assert printed.inputFiles() and not any("lineitem" in f for f in printed.inputFiles())
    assert printed.where("kind = 'data'").count() > 0


@pytest.mark.parametrize("name", ["table_lines", "table_totals", "nearest_columns"])
def test_no_rows_of_tables_pass_through_the_driver(spark, monkeypatch, name):
    """Files are many times smaller than their rows, so a join that may choose broadcasts what grows with the tables."""
    seen = []
    noted = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString())
    for place, cut in ((Shelf, Shelf.cut), (Q, Q.cut)):
        monkeypatch.setattr(place, "cut", lambda *a, cut=cut: (noted(a[-2]), cut(*a))[1])
    noted(getattr(Q, name)(spark, "/root/testdata/sf0.001"))
    assert any("Join" in plan for plan in seen) and not any("Broadcast" in plan for plan in seen)
