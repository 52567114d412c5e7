"""Labels from taxonomies and neighbours, on small fixtures."""

from __future__ import annotations

import datetime

import pytest

from ledgerloom.operators import labels as L

CHECKS = {t: concepts for t, _, concepts in L.STATEMENTS}
TITLES = {
    "comprehensive_income": "STATEMENTS OF COMPREHENSIVE INCOME", "cash_flow_statement": "Statements of Cash Flows", "balance_sheet": "Statements of Financial Position",
    "equity_statement": "Statements of Changes in Equity", "income_statement": "Statements of Earnings",
}


def roles_of(spark, filings):
    """filings: name -> list of (title, concepts)."""
    roles = [(f, f"{f}{k}", title) for f, rows in filings.items() for k, (title, _) in enumerate(rows)]
    held = [(f, f"{f}{k}", c) for f, rows in filings.items() for k, (_, concepts) in enumerate(rows) for c in (*concepts, "x:Other")]
    return spark.createDataFrame(roles, "filing string, role string, title string"), spark.createDataFrame(held, "filing string, role string, concept string")


def test_roles_map_one_to_one(spark):
    whole = [(TITLES[t], CHECKS[t]) for t in TITLES]
    both = ("Statements of Operations and Comprehensive Income", (*CHECKS["comprehensive_income"], *CHECKS["income_statement"]))
    filings = {
        "a": whole, "b": [r for r in whole if "INCOME" not in r[0] and "Earnings" not in r[0]] + [both], "c": whole[:-1], "d": [*whole, ("Consolidated Balance Sheets", CHECKS["balance_sheet"])],
        "e": [*whole[1:], ("Comprehensive income", ())], "f": [*whole, ("Segments", ())],
    }
    found = L.role_types(*roles_of(spark, filings)).collect()
    by = {f: {r["type"]: r["problem"] for r in found if r["filing"] == f} for f in filings}
    assert by["a"] == dict.fromkeys(TITLES) and by["b"] == {t: None for t in TITLES if t != "comprehensive_income"}
    assert set(by["c"].values()) == {"missing income_statement"}
    assert by["d"]["balance_sheet"] == "two roles of balance_sheet" and by["d"]["equity_statement"] is None
    assert by["e"]["comprehensive_income"] == "does not present the concepts of comprehensive_income"
    assert by["f"][None] == "no type by its title: Segments"
    good = L.role_types(*roles_of(spark, {"a": whole}))
    assert L.raised(good).count() == 5
    with pytest.raises(Exception, match="missing income_statement"):
        L.raised(L.role_types(*roles_of(spark, {"c": whole[:-1]}))).collect()
    assert L.role_types(*(df.limit(0) for df in roles_of(spark, {"a": whole}))).count() == 0


def test_tables_of_statements(spark):
    tables = [("f", 1, c) for c in "abcd"] + [("f", 2, c) for c in "abxy"] + [("f", 3, c) for c in "xyz"] + [("g", 1, c) for c in "abxy"]
    presented = [("f", "r", c) for c in "abcd"] + [("f", "s", c) for c in "xyzw"] + [("f", "t", c) for c in "klmno"] + [("g", "r", c) for c in "ab"] + [("g", "s", c) for c in "xy"]
    roles = [("f", "r", "balance_sheet"), ("f", "s", "equity_statement"), ("f", "t", "income_statement"), ("g", "r", "balance_sheet"), ("g", "s", "equity_statement")]
    found = L.statement_tables(spark.createDataFrame(tables, "filing string, table int, concept string"), spark.createDataFrame(roles, "filing string, role string, type string"), spark.createDataFrame(presented, "filing string, role string, concept string"))
    got = {(r["filing"], r["role"]): (r["table"], r["coverage"], r["problem"]) for r in found.collect()}
    one = "one table for balance_sheet and equity_statement"
    assert got == {("f", "r"): (1, 1.0, None), ("f", "s"): (3, 0.75, None), ("f", "t"): (None, 0.0, "no table covers income_statement"), ("g", "r"): (1, 1.0, one), ("g", "s"): (1, 1.0, one)}


def test_periods_of_rows(spark):
    day = datetime.date
    contexts = [
        ("f", "y31", day(2030, 6, 1), day(2031, 5, 31), None, 2031), ("f", "y30", day(2029, 6, 1), day(2030, 5, 31), None, 2030), ("f", "i30", None, None, day(2030, 5, 31), None),
        ("f", "q", day(2031, 3, 1), day(2031, 5, 31), None, None), ("f", "d", day(2031, 5, 1), day(2031, 5, 1), None, None), ("f", "odd", day(2031, 5, 1), day(2031, 5, 20), None, None),
    ]
    rows = [(1, 1, "Opening", None), (1, 2, "Dug", None), (1, 3, "Both", None), (1, 4, "Closing 2031", None), (1, 5, "", None), (1, 6, "Plain", None), (1, 7, "Dug", "In 2030"), (1, 8, "Late", None), (1, 9, "Once", None), (1, 10, "Span", None), (2, 1, "One", None), (2, 2, "Two", None)]
    values = [(1, 1, "Cost", "i30"), (1, 2, "Cost", "y31"), (1, 2, "Value", "y31"), (1, 3, "Cost", "y31"), (1, 3, "Value", "y30"), (1, 4, "Cost", "y31"), (1, 5, "Cost", "y30"), (1, 6, "Cost", None), (1, 7, "Cost", "y30"), (1, 8, "Cost", "q"), (1, 9, "Cost", "d"), (1, 10, "Cost", "odd"), (2, 1, "Cost", "y31"), (2, 2, "Cost", "y31")]
    df = lambda rows, schema: spark.createDataFrame([("f", *r) for r in rows], "filing string, " + schema)
    known = spark.createDataFrame(contexts, "filing string, context string, start date, end date, instant date, fiscal_year int")
    found = L.row_periods(df(rows, "table int, row int, label string, grp string"), df(values, "table int, row int, column string, context string"), known, fiscal=True)
    got = {(r["table"], r["row"]): r["label"] for r in found.collect()}
    assert [got[1, k] for k in range(1, 11)] == [
        "Opening (as of May 31, 2030)", "Dug (fiscal 2031, year ended May 31, 2031)", "Both", "Closing 2031", "", "Plain", "Dug", "Late (three months ended May 31, 2031)", "Once (on May 1, 2031)", "Span (May 1, 2031 to May 20, 2031)",
    ]
    assert (got[2, 1], got[2, 2]) == ("One", "Two")
    plain = L.row_periods(df(rows, "table int, row int, label string, grp string"), df(values, "table int, row int, column string, context string"), known)
    assert "Dug (year ended May 31, 2031)" in {r["label"] for r in plain.collect()}


def test_paragraphs_over_page_breaks(spark):
    rows = [
        ("text", "The kiln was", "a"), ("text", "12", "a"), ("text", "hot and", "a"), ("text", "red.", "a"), ("text", "over", "a"), ("text", "Capital", "a"), ("text", "well-", "a"), ("text", "known", "a"),
        ("text", "to us", "b"), ("table", None, "b"), ("text", "after a table", "b"), ("text", "he said “so.”", "b"), ("text", "éclat", "b"), ("text", "", "b"), ("text", "end", "b"), ("text", None, "b"),
    ]
    df = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc string, seq int, kind string, text string, topic string")
    got = [(r["seq"], r["text"], r["pieces"]) for r in L.joined_paragraphs(df).orderBy("seq").collect()]
    assert got == [
        (0, "The kiln was hot and red.", 3), (1, "12", 1), (4, "over", 1), (5, "Capital well-known", 3), (8, "to us", 1), (9, None, 1), (10, "after a table he said “so.”", 2), (12, "éclat", 1), (13, "", 1), (14, "end", 1), (15, None, 1),
    ]


def test_sections_take_lead_in_along(spark):
    rows = [
        ("text", None, None, False), ("table", None, "balance_sheet", False), ("text", None, None, False), ("text", None, None, False), ("table", None, "income_statement", False), ("table", None, None, False),
        ("text", None, None, False), ("table", None, "equity_statement", False), ("text", "Taxes", None, False), ("text", "Taxes", None, True), ("table", "Taxes", None, False),
    ]
    df = spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc string, seq int, kind string, topic string, statement_type string, starts boolean")
    found = L.block_sections(df)
    assert [r["section"] for r in found.orderBy("seq").collect()] == [1, 1, 2, 2, 2, 2, 3, 3, 4, 5, 5]
    kinds = {r["section"]: (r["statement_type"], r["problem"]) for r in L.section_statement(found, ["doc", "section"]).collect()}
    assert kinds == {1: ("balance_sheet", None), 2: ("income_statement", None), 3: ("equity_statement", None), 4: ("narrative", None), 5: ("narrative", None)}
    whole = L.section_statement(df.where("seq < 5"), ["doc"]).first()
    assert whole["problem"] == "tables of balance_sheet and income_statement"
