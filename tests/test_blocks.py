"""Blocks of pages, and tables of cells as labelled lines, on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cells as C
from ledgerloom.sources.blocks import blocks, grid, read_blocks


def _texts(body: str) -> list[str]:
    return [b[1] for b in read_blocks(f"<html><body>{body}</body></html>")]


@pytest.mark.parametrize(
    ("body", "said"),
    [
        ("<ol>\n<li>ore</li>\n<li>tin</li>\n</ol><ol start=7><li>zinc</ol><ul><li>lead</ul>", ["1. ore", "2. tin", "7. zinc", "* lead"]),
        ("<div><p><span>Chapter</span></p></div><div><span>One</span><span> of many</span></div>", ["Chapter", "One of many"]),
        ("<div><span>&#8226;</span><div>Sieved.</div></div><p>4.</p><p>Kilns</p>", ["• Sieved.", "4. Kilns"]),
        ("<p>Yield   of\n  clay\xa0\xa0grew</p>", ["Yield of clay\xa0\xa0grew"]),
        ("<p>Shift A<br/>Oven 2</p><hr><p>q<img src=i></p>", ["Shift A\nOven 2", "---", "q[image]"]),
        ('<p>As in <a href="#k"><span>Table 2</span></a>.</p><p><a href="#t">Table of Contents</a></p><p><a href="#e"></a>z</p>', ["As in [Table 2](#k).", "z"]),
        ("<p>Kept*</p><script>var a</script><ix:header><p>hidden</p></ix:header><style>p {}</style>", ["Kept\\*"]),
        ("<p>never closed", ["never closed"]),
    ],
)
def test_blocks_of_a_page(body, said):
    assert _texts(body) == said


@pytest.mark.parametrize(
    "page",
    ["<html><head><meta><body><p>All", "<html><head><link><p>All</p>", "<head><title>t</title><p>All", "<body><noscript><p>All</p>", "<ix:header><p>All", "<html><head><meta>All"],
)
def test_what_is_never_closed_hides_nothing(page):
    assert "All" in [text for _, text, _ in read_blocks(page)]


def test_cells_over_rows_and_columns_hold_their_place():
    placed = grid([[("", 1, 1, 0.0), ("North", 2, 1, 0.0), ("All", 1, 2, 0.0), ("South", 2, 1, 0.0)], [("", 1, 1, 0.0), *((t, 1, 1, 0.0) for t in ("wet", "dry", "wet", "dry"))]])
    assert [c[1:4] for c in placed if c[0] == 1] == [(1, 1, "wet"), (2, 2, "dry"), (4, 4, "wet"), (5, 5, "dry")]
    assert [c[1] for c in grid([[("a", 1, 0, 0.0)], [("b", 1, 1, 0.0)], [("c", 1, 1, 0.0)]])] == [0, 1, 1]


#: Name -> rows of cells: a text, or (text, columns), or (text, columns, indent).
TABLES = {
    "sign": [["(in thousands)", "", "", "", "", "", ""], ["Season ended", "", "2031", "", "", "2030", ""], ["Clay dug", "", "$", "4,120", "", "$", "3,987"]],
    "second header": [["", "2031", "2030"], ["Tiles", "6", "5"], ["", "Crates", "Weight"], ["Stock", "7", "8"]],
    "units over all": [[("", 3), ("Season ended May 31,", 6)], [("", 3), ("2031", 3), ("2030", 3)], [("", 3), ("(in millions)", 6)], [("Glaze", 3), "$", "10", "", "$", "9", ""]],
    "years below": [["", ("Crates", 2), ("Price", 2)], ["Season", ("2031", 4)], ["Spring", "8", "", "$", "39"]],
    "two under one": [["", ("2031", 2), ("Change", 3)], ["Kilns", "$", "45", "$", "6", "16%"]],
    "total": [["", "2031"], ["Wares:", ""], ["Cups", "5"], ["Bowls", "6"], ["Total wares", "11"], ["Loans", "7"]],
    "unnamed total": [["", "2031", "2030"], ["Oven:"], ["a", "5", "1"], ["b", "6", "2"], ["Used by ovens", "11", "3"], ["Later", "1", "1"]],
    "running": [["", "2031", "2030"], ["Dug:"], ["a", "5", "1"], ["b", "6", "2"], ["Net dug", "11", "3"], ["Fired:"], ["c", "7", "4"], ["d", "8", "5"], ["Change", "26", "12"], ["After", "1", "1"]],
    "subtotal": [["", "2031", "2030"], ["Wares:"], ["a", "5", "1"], ["b", "6", "2"], ["Ready", "11", "3"], ["c", "1", "1"], ["Total wares", "12", "4"], ["x", "1", "9"]],
    "outdent": [["", "2031"], ["Wares:"], [("a", 1, 10), "5"], [("b", 1, 10), "6"], [("Rent", 1, 0), "3"], ["Total", "14"]],
    "given back": [["", "2031"], ["Wares:"], [("a", 1, 10), "5"], [("b", 1, 0), "6"], ["Total wares", "11"], ["x", "2"]],
    "rates": [["", "2031", "2030"], ["Rates:"], ["a", "1.5%", "2%"], ["b", "(0.5)%", "1%"], ["Whole", "1.0%", "3%"], ["x", "9%", "9%"]],
    "rounded": [["", "2031", "2030"], ["Wares:"], ["a", "5", "1"], ["b", "6", "2"], ["Sum", "12", "4"], ["x", "2", "2"]],
    "too far": [["", "2031", "2030"], ["Wares:"], ["a", "5", "1"], ["b", "6", "2"], ["Sum", "13", "3"], ["x", "2", "2"]],
    "periods": [["", "Cost", "Value"], ["May 31, 2031"], ["Bonds:"], ["a", "1", "2"], ["May 31, 2030"], ["a", "3", "4"]],
    "text": [["•", "a point"], ["Note", "words"]],
    "loose": [["", "Crates"], ["10.1", "1,250"], ["Kiln", "9"], ["Salt", "12"], ["31.1", "a seal"]],
    "two values": [["a", "1", "2"]],
    "under two": [["", ("A", 2), ("B", 2)], ["x", "", ("7", 2), ""]],
    "unused": [["", "2031", "Note"], ["Cups", "5", ""], ["Bowls", "6", ""]],
}
LINES = {
    "sign": ["(in thousands)", "Clay dug — Season ended 2031: $4,120 | Season ended 2030: $3,987"],
    "second header": ["Tiles — 2031: 6 | 2030: 5", "Stock — Crates: 7 | Weight: 8"],
    "units over all": ["(in millions)", "Glaze — Season ended May 31, 2031: $10 | Season ended May 31, 2030: $9"],
    "years below": ["Spring — Season 2031 Crates: 8 | Season 2031 Price: $39"],
    "two under one": ["Kilns — 2031: $45 | Change: $6 / 16%"],
    "total": ["Wares:", "Wares > Cups — 2031: 5", "Wares > Bowls — 2031: 6", "Wares > Total wares — 2031: 11", "Loans — 2031: 7"],
    "unnamed total": ["Oven:", "Oven > a — 2031: 5 | 2030: 1", "Oven > b — 2031: 6 | 2030: 2", "Oven > Used by ovens — 2031: 11 | 2030: 3", "Later — 2031: 1 | 2030: 1"],
    "running": ["Dug:", "Dug > a — 2031: 5 | 2030: 1", "Dug > b — 2031: 6 | 2030: 2", "Dug > Net dug — 2031: 11 | 2030: 3", "Fired:", "Fired > c — 2031: 7 | 2030: 4", "Fired > d — 2031: 8 | 2030: 5", "Change — 2031: 26 | 2030: 12", "After — 2031: 1 | 2030: 1"],
    "subtotal": ["Wares:", *(f"Wares > {t}" for t in ("a — 2031: 5 | 2030: 1", "b — 2031: 6 | 2030: 2", "Ready — 2031: 11 | 2030: 3", "c — 2031: 1 | 2030: 1", "Total wares — 2031: 12 | 2030: 4")), "x — 2031: 1 | 2030: 9"],
    "outdent": ["Wares:", "Wares > a — 2031: 5", "Wares > b — 2031: 6", "Rent — 2031: 3", "Total — 2031: 14"],
    "given back": ["Wares:", "Wares > a — 2031: 5", "Wares > b — 2031: 6", "Wares > Total wares — 2031: 11", "x — 2031: 2"],
    "rates": ["Rates:", "Rates > a — 2031: 1.5% | 2030: 2%", "Rates > b — 2031: (0.5)% | 2030: 1%", "Rates > Whole — 2031: 1.0% | 2030: 3%", "x — 2031: 9% | 2030: 9%"],
    "rounded": ["Wares:", "Wares > a — 2031: 5 | 2030: 1", "Wares > b — 2031: 6 | 2030: 2", "Wares > Sum — 2031: 12 | 2030: 4", "x — 2031: 2 | 2030: 2"],
    "too far": ["Wares:", *(f"Wares > {t}" for t in ("a — 2031: 5 | 2030: 1", "b — 2031: 6 | 2030: 2", "Sum — 2031: 13 | 2030: 3", "x — 2031: 2 | 2030: 2"))],
    "periods": ["May 31, 2031", "Bonds:", "May 31, 2031 > Bonds > a — Cost: 1 | Value: 2", "May 31, 2030", "May 31, 2030 > a — Cost: 3 | Value: 4"],
    "text": ["• a point", "Note | words"],
    "loose": ["10.1 | 1,250", "Kiln — Crates: 9", "Salt — Crates: 12", "31.1 | a seal"],
    "two values": ["a | 1 | 2"],
    "under two": ["A | B", "x | 7"],
    "unused": ["2031 | Note", "Cups | 5", "Bowls | 6"],
}
FALLBACK = {"text": "no row of values", "two values": "several values in a row without column headers", "under two": "a value under two columns", "unused": "lost: Note"}
SCHEMA = "table string, row int, start int, end int, text string, indent double"


def _cells(name: str) -> list[tuple]:
    rows = [[((*c, 1, 0.0)[:3] if len(c) < 3 else c) if isinstance(c, tuple) else (c, 1, 0.0) for c in row] for row in TABLES[name]]
    rows = [[(c[0], c[1], 1, float(c[2]) if len(c) > 2 else 0.0) for c in row] for row in rows]
    return [(name, *c) for c in grid(rows)]


@pytest.fixture(scope="module")
def read(spark):
    found = C.lines(spark.createDataFrame([c for name in TABLES for c in _cells(name)], SCHEMA)).orderBy("table", "at").collect()
    return {name: ([r.line for r in found if r.table == name], {r.fallback for r in found if r.table == name}) for name in TABLES}


@pytest.mark.parametrize("name", TABLES)
def test_lines_of_a_table(read, name):
    if name == "loose":  # a number as the first cell is a value of its own kind; what matters is that nothing is lost
        said = "\n".join(read[name][0])
        assert all(c[4] in said for c in _cells(name))
    else:
        assert read[name] == (LINES[name], {FALLBACK.get(name)})


def test_no_text_of_a_table_is_lost(spark):
    import random

    rng = random.Random(4)
    texts = ["", "a", "Total b", "2031", "7", "$", "(3", ")", "%", "—", "(in millions)", "May 31, 2031", "b:"]
    tables = {f"t{k}": grid([[(rng.choice(texts), rng.randint(1, 3), rng.randint(1, 2), 0.0) for _ in range(rng.randint(1, 5))] for _ in range(rng.randint(1, 6))]) for k in range(150)}
    found = C.lines(spark.createDataFrame([(n, *c) for n, cells in tables.items() for c in cells], SCHEMA)).groupBy("table").agg(F.array_join(F.collect_list("line"), "\n").alias("said")).collect()
    said = {r.table: r.said for r in found}
    for name, cells in tables.items():
        assert all(c[3] in said[name] for c in cells), (cells, said[name])


def test_amounts(spark):
    said = {"$(1,610)": (-1610, 1), "3.32": (3.32, 0.01), "-5": (-5, 1), "5%": None, "—": None, "": None, "a": None, "(7": (7, 1), ".5": (0.5, 0.1)}
    found = spark.createDataFrame([(t,) for t in said], "t string").select("t", C.amount(F.col("t")).alias("a")).collect()
    assert {r.t: r.a and (float(r.a.value), float(r.a.unit)) for r in found} == said


def test_totals_name_groups(spark):
    rows = [("Total finance lease costs", "Finance Leases:", True), ("Total costs and debts", "Debts", False), ("Total", "Wares", False), ("Total wares", "", False)]
    got = spark.createDataFrame(rows, "t string, g string, w boolean").select("w", C.names_group(F.col("t"), F.col("g")).alias("n")).collect()
    assert all(r.w == r.n for r in got)


def test_blocks_of_awkward_pages(spark):
    table = "<table><tr><td><td>2031</tr><tr><td style='padding-left:9pt'>Clay<td>4<td>)</tr></table>"
    rows = [(1, None), (2, ""), (3, f"<p>a</p>{table}<p>b</p>"), (3, f"<p>a</p>{table}<p>b</p>"), (None, "<td>x"), (4, "<p>" + "word " * 300_000)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, html string, seq string")
    found = sorted((r.page_id or 0, r.seq, r.kind, r.text if len(r.text) < 99 else len(r.text)) for r in blocks(pages).collect())
    page = [(3, 0, "text", "a"), (3, 1, "table", "Clay — 2031: 4)"), (3, 2, "text", "b")]
    assert found == sorted([(0, 0, "text", "x"), *page, *page, (4, 0, "text", 1_499_999)])
    assert blocks(pages.limit(0)).count() == 0
    assert C.lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_runs_are_read_in_linear_time(spark):
    assert _texts("<p>" + "<a href=x>" * 20_000 + "<span> </span>" * 100_000 + "end") == ["[end](x)"]
    rows = [("long", 0, 1, 1, "2031", 0.0)] + [("long", k, c, c, t, 0.0) for k in range(1, 20_001) for c, t in ((0, f"row {k}"), (1, f"{k},000"))]
    assert C.lines(spark.createDataFrame(rows, SCHEMA)).count() == 20_000
