"""Rules against golden values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.operators import evaluation as E
from ledgerloom.streaming.guard import outcome


def each(spark, values, f, schema="a string"):
    """f of every row, in the order given."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    names = [c.split()[0] for c in schema.split(", ")]
    return [r[0] for r in spark.createDataFrame(rows, "i int, " + schema).orderBy("i").select(f(*(F.col(n) for n in names))).collect()]


def test_statement_titles(spark):
    cases = {
        "CONSOLIDATED BALANCE SHEETS": "balance_sheet", "Statements of Cash Flows": "cash_flow_statement", "CASH FLOWS STATEMENTS": "cash_flow_statement",
        "Consolidated Statements of Changes in Stockholders’ Equity": "equity_statement", "STOCKHOLDERS' EQUITY STATEMENTS": "equity_statement",
        "COMPREHENSIVE INCOME STATEMENTS": "comprehensive_income", "INCOME STATEMENTS": "income_statement", " consolidated statements of operations ": "income_statement",
        "OPERATIONS": None, "Cash Flows": None, "COMPREHENSIVE INCOME": None, "INCOME": None, "Balance sheets of the company": None, "": None,
    }
    assert each(spark, list(cases), T.statement_title) == list(cases.values())
    assert each(spark, ["Notes to Consolidated Financial Statements", "Notes", "BALANCE SHEETS"], T.is_statement_boundary) == [True, False, True]


def test_routing_and_synthesis(spark):
    asked = {"What was the gross margin?": "income_statement", "Total assets at year end": "balance_sheet", "changes in stockholders' equity": "equity_statement", "revenue and total assets": None, "other comprehensive income": "comprehensive_income", "who?": None}
    assert each(spark, list(asked), T.statement_of_question) == list(asked.values())
    assert each(spark, ["Compare A and B", "A vs B", "the ratio", "What was revenue?"], T.needs_synthesis) == [True, True, True, False]


def test_keyword_query(spark):
    names = F.array(F.lit("microsoft"), F.lit("msft"))
    asked = ["What was Microsoft's Intelligent Cloud segment revenue?", "total value in fiscal 2025", "31 securities in 2024"]
    assert each(spark, asked, lambda q: T.keyword_query(q, names)) == ['"intelligent" OR "cloud" OR "segment" OR "revenue"', None, '"31" OR "securities"']


def test_names(spark):
    assert each(spark, ["Nasdaq, Inc.", "The Coca-Cola Company", "Corporation", "Oracle Corporation", "A B Co., Ltd."], T.short_name) == ["Nasdaq", "Coca-Cola", "Corporation", "Oracle", "A B"]
    clean = {"MICROSOFT CORPORATION": "Microsoft Corporation", "KPMG LLP": "KPMG LLP", "AT&T INC.": "AT&T Inc.", "NEW YORK, NY": "New York, NY", "New York,": "New York", " ; ": None}
    assert each(spark, list(clean), T.clean_value) == list(clean.values())
    assert each(spark, ["INCOME TAXES", "Revenue From Us", "STATEMENTS OF CASH AND DEBT"], T.topic_title) == ["Income Taxes", "Revenue From Us", "Statements of Cash and Debt"]
    line = lambda n, s, f, y: T.company_line(n, F.split(s, "/"), f, y)
    assert each(spark, [("Oracle Corporation", "ORCL", "10-K", "2026"), ("A", "", None, None)], line, "n string, s string, f string, y string") == ["Oracle Corporation (ORCL), Form 10-K for fiscal year 2026.", "A."]


def test_embedding_text(spark):
    table = "Lead\n  | Revenue | 1 |\n|---|---|\n| Revenue | 2 |\n| 12 | 3 |\n| Cost | 4 |"
    assert each(spark, [table, "prose", "| 1 | 2 |"], lambda c: T.embedding_text(F.lit("H"), c)) == [f"H\nFinancial data table with rows: Revenue, Cost.\n\n{table}", "H\n\nprose", "H\nFinancial data table.\n\n| 1 | 2 |"]


def test_numbers(spark):
    given = [("7,425,545,491", "ixt:num-dot-decimal"), ("3.6", None), ("—", "ixt:fixed-zero"), ("three", "ixt-sec:numwordsen"), ("No", "ixt-sec:numwordsen"), (None, None)]
    assert [None if x is None else float(x) for x in each(spark, given, N.ix_number, "t string, f string")] == [7425545491.0, 3.6, 0.0, 3.0, 0.0, None]
    for bad in (("1", "ixt:other"), ("1,2,3", "ixt:num-dot-decimal"), ("many", "ixt-sec:numwordsen")):
        with pytest.raises(Exception, match="format|word"):
            each(spark, [bad], N.ix_number, "t string, f string")
    texts = {
        ("December 11, 2025", "ixt:date-monthname-day-year-en"): "2025-12-11", ("September 2026", "ixt:date-monthname-year-en"): "2026-09", ("June 30", "ixt:date-monthname-day-en"): "--06-30",
        ("2.3", "ixt-sec:duryear"): "P2Y3M18D", ("1.53", "ixt-sec:duryear"): "P1Y6M10D", ("7.58", "ixt-sec:duryear"): "P7Y6M29D", ("8.4", "ixt-sec:duryear"): "P8Y4M24D", ("0", "ixt-sec:duryear"): "P0Y",
        ("268", "ixt-sec:durday"): "P268D", ("☒", "ixt-sec:boolballotbox"): "true", ("☐", "ixt-sec:boolballotbox"): "false", (" x ", None): "x",
        ("twenty-five years", "ixt-sec:durwordsen"): "P25Y", ("one year and six months", "ixt-sec:durwordsen"): "P1Y6M", ("15 years", "ixt-sec:durwordsen"): "P15Y", ("one- year", "ixt-sec:durwordsen"): "P1Y",
    }
    assert each(spark, list(texts), N.ix_text, "t string, f string") == list(texts.values())
    for bad in ("1.5 years", "thirty years", "soon"):
        with pytest.raises(Exception, match="words"):
            each(spark, [bad], N.words_duration)


def test_rounding(spark):
    cases = {("9.13", 10**9, "9,127,167"): True, ("45.2", 10**9, "45,183,036"): True, ("26.4", 10**9, "26,445"): True, ("5.8", 10**6, "5,787,000"): True, ("9.12", 10**9, "9,127,167"): False, ("5.76", 10**9, "5,725"): False, ("0.0", 10**9, "1"): False, ("2.5", 10**9, "2,450"): True, ("2.4", 10**9, "2,450"): False}
    assert each(spark, list(cases), N.rounds_to, "f string, s long, x string") == list(cases.values())
    even = {("55.9", "55,850"): True, ("55.8", "55,850"): False, ("2.67", "2675"): True, ("2.68", "2675"): False, ("0.12", "125"): True, ("0.38", "375"): True, ("3.1", "3,074"): True, ("55.7", "55,663"): True, ("26.3", "26,445"): False}
    even |= {(f"{round(v / 1000, p):.{p}f}", str(v)): True for v in (5, 15, 25, 35, 1005, 8615, 70_650, 123_455, 1_250) for p in (1, 2)}
    assert each(spark, list(even), N.rounds_thousandths, "f string, s string") == list(even.values())
    amounts = each(spark, ["$ (1,234.5)", "7", "12 %", "-3.25"], N.printed_amount)
    assert [a and (float(a["value"]), float(a["unit"])) for a in amounts] == [(-1234.5, 0.1), (7.0, 1.0), None, (-3.25, 0.01)]


def test_line_window(spark):
    long = "x" * 300 + " 12 " + "y" * 300 + " 2,435"
    got = each(spark, [("short 12", "12"), (long, "2,435"), (long, "12"), (long, "9")], T.line_window, "l string, f string")
    assert got[0] == "short 12" and got[1].startswith("...") and got[1].endswith("2,435") and len(got[1]) == 163
    assert got[2].startswith("...x") and got[2].endswith("y...") and got[2][83:85] == "12" and got[3] == long[:160] + "..."


def test_strict_grades(spark):
    q = "What was revenue in 2025?"
    ok = dict(question=q, kind="figure", unit="million", expect=["26,445"], conflicts=["616"], traps=["99"], accept=[("7.1", "diluted")], exact=False, decline_ok=False)
    cases = [
        ({}, "Revenue was $26,445 million.", "reliable", ""),
        ({}, "Revenue was $26,445 thousand.", "wrong-unit", "expected million"),
        ({}, "Revenue was $26,445.", "no-unit", "expected million"),
        ({}, "Revenue was $26.4 billion.", "reliable", "rounded, in billions"),
        ({"exact": True}, "Revenue was $26.4 billion.", "wrong", "expected figure absent"),
        ({}, "It was $26,445 million. The other line is $616 million.", "reliable", "names 616 as the contrast"),
        ({}, "It was $26,445 million. Therefore, the total is $616 million.", "check", "also states 616"),
        ({}, "It is ambiguous: $26,445 million. Or $616 million.", "check", "also states 616"),
        ({}, "It was $616 million, not $26,445 million.", "check", "also states 616"),
        ({}, "The diluted figure was 7.1 million.", "reliable", ""),
        ({}, "It was 99 million.", "wrong", "trap 99"),
        ({}, "The excerpts don't contain it.", "declined", ""),
        ({}, "The excerpts don't contain it, but 99 is there.", "check", "declines but states 99"),
        ({}, "The unit for the figures is not stated.", "malformed", "the units rule as the whole answer"),
        ({"kind": "negative"}, "The excerpts do not mention December 31, 2024.", "decline-ok", ""),
        ({"kind": "negative"}, "There is no mention, so $0.", "check", "declines but states figures"),
        ({"kind": "negative"}, "It was 5.", "wrong", "answered a negative"),
        ({"kind": "routing"}, "Not stated.", "decline-ok", "routing test"),
        ({"kind": "fact", "expect": ["Deloitte"], "conflicts": ["KPMG"]}, "deloitte and KPMG", "check", "also names KPMG"),
        ({"kind": "fact", "expect": ["Deloitte"], "conflicts": None}, "Deloitte", "reliable", ""),
        ({"kind": "fact", "expect": ["Deloitte"]}, "EY", "wrong", "missing Deloitte"),
        ({"kind": "fact", "expect": ["Deloitte"], "decline_ok": True}, "Unable to say.", "decline-ok", ""),
        ({"expect": ["1", "2"], "unit": None}, "It is 1.", "wrong", "only 1 of 1, 2"),
        ({"unit": "%", "expect": ["4.5"]}, "It grew 4.5 percent.", "reliable", ""),
        ({"unit": "$", "expect": ["4.5"]}, "It paid $ (4.5) each.", "reliable", ""),
    ]
    schema = "i int, answer string, question string, kind string, unit string, expect array<string>, conflicts array<string>, traps array<string>, accept array<struct<value:string,if_label:string>>, exact boolean, decline_ok boolean"
    names = [c.split()[0] for c in ("question string, kind string, unit string, expect x, conflicts x, traps x, accept x, exact x, decline_ok x").split(", ")]
    rows = [(i, answer, *((ok | change)[n] for n in names)) for i, (change, answer, _, _) in enumerate(cases)]
    got = {r["i"]: (r["status"], r["note"]) for r in E.strict_grades(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: (s, n) for i, (_, _, s, n) in enumerate(cases)}


def test_guard(spark):
    rows = [("a", 1, "x", None), ("a", 2, "", "length"), ("b", 1, "", "length"), ("b", 2, "", None), ("c", 1, "x", None), ("c", 2, "", "content_filter"), ("c", 3, "", None), ("d", 1, "x", "content_filter"), ("d", 2, "", "stop"), ("e", 1, None, None)]
    got = {r[0]: r[1] for r in outcome(spark.createDataFrame(rows, "answer_id string, seq int, text string, finish_reason string")).collect()}
    assert got == {"a": "ok", "b": "starved", "c": "filtered", "d": "ok", "e": "ok"}
