"""Figures of answers, on small fixtures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import figures as G

ANSWER = "id string, answer string, question string, kind string, passed boolean, expect array<string>, inputs array<string>"
EXCERPT = "id string, position int, content string"
ROWS = [
    ("traced", "Clay cost 4,120 and (26,445).", "What?", "figure", False, ["26,445"], ["4,120"]),
    ("none", "Austin", "Where?", "fact", False, ["Leeds"], None),
    ("rounds", "It was $9,127,167 thousand (about $9.13 billion).", "What?", "figure", True, ["9,127,167"], None),
    ("no round", "It was 9,127,167 thousand (about 9.14 billion).", "What?", "figure", False, ["9,127,168"], ["9,127,167"]),
    ("sum", "Together 30.", "What?", "figure", False, ["30"], ["Cups 10", "Bowls 20"]),
    ("invented", "It was 77 on May 31, 2031.", "What?", "figure", False, ["78"], ["78"]),
    ("asked", "The 12 kilns.", "Are there 12 kilns?", "figure", False, ["12"], None),
    ("negative", "None of 5.", "What?", "negative", False, ["5"], None),
    ("half", "Between 1,250 and 1.3 million.", "What?", "figure", False, ["x"], None),
    ("empty", None, None, None, None, None, None),
    (None, "It was 5.", "What?", "figure", False, ["5"], None),
]
TEXTS = [
    ("traced", 1, "Clay — 2031: 4,120\nClay — 2030: 4,120"), ("traced", 2, "Sold — (26,445) | 14,120"), ("none", 1, "made in leeds\nand york"),
    ("rounds", 3, "Sales 9,127,167"), ("no round", 1, "Sales 9,127,167"), ("sum", 1, "Cups 10"), ("sum", 2, "Bowls 20"), ("invented", 1, "Kilns 777"), ("half", 1, "1,250"), ("empty", 1, None), (None, 1, "5"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(ROWS, ANSWER), spark.createDataFrame(TEXTS, EXCERPT)


def test_statuses(tables):
    got = {r["id"]: (r["status"], r["stated"]) for r in G.figure_sources(*tables).collect()}
    assert got == {
        "traced": ("traced", "4,120 from excerpt 1, 26,445 from excerpt 2"),
        "none": ("no figure stated", None),
        "rounds": ("traced", "9,127,167 from excerpt 3, 9.13 (rounds 9,127,167) from excerpt 3"),
        "no round": ("untraced", "9,127,167 from excerpt 1, 9.14 from no excerpt"),
        "sum": ("calculated", "30 from no excerpt"),
        "invented": ("untraced", "77 from no excerpt"),
        "asked": ("no figure stated", None),
        "negative": ("untraced", "5 from no excerpt"),
        "half": ("traced", "1,250 from excerpt 1, 1.3 (rounds 1,250) from excerpt 1"),
        "empty": ("no figure stated", None),
    }


def test_excerpts_are_read_once(spark, tables):
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    excerpts = spark.createDataFrame(spark.sparkContext.parallelize(TEXTS, 2).map(counted), EXCERPT)
    got = sorted((r["id"], r["place"], r["figure"], r["positions"], r["rounds"]) for r in G.trace(tables[0], excerpts).collect())
    assert read.value == len(TEXTS)
    assert ("rounds", 1, "9.13", [3], "9,127,167") in got and ("traced", 1, "26,445", [2], None) in got and ("sum", 0, "30", None, None) in got
    assert {r[0] for r in got}.isdisjoint({"none", "asked", "empty", None})


def test_roundings_of_one_answer(spark):
    answers = spark.createDataFrame([("a", "1,250 and 1,349 are 1.3 million, 0.0 billion, 1.25 million, 9 million.", None), ("b", "1.3 million", None), ("c", "Of 7 and 7.", None)], "id string, answer string, question string")
    excerpts = spark.createDataFrame([("a", 2, "1,250"), ("a", 1, "1,349\n1,250"), ("a", 1, "1,250"), ("b", 1, "1,250"), ("c", None, "7")], EXCERPT)
    got = {(r["id"], r["figure"]): (r["place"], r["positions"], r["rounds"]) for r in G.trace(answers, excerpts).collect()}
    assert got == {
        ("a", "1,250"): (0, [1, 2], None), ("a", "1,349"): (1, [1], None), ("a", "1.3"): (2, [1, 2], "1,250"), ("a", "0.0"): (3, None, None),
        ("a", "1.25"): (4, [1, 2], "1,250"), ("a", "9"): (5, None, None), ("b", "1.3"): (0, None, None), ("c", "7"): (0, [], None),
    }


def test_lines_of_sightings(tables):
    answers, excerpts = tables
    got = {(r["id"], r["figure"]): (r["position"], r["line"], r["more"]) for r in G.sightings(G.figures(answers), excerpts).collect()}
    assert got["traced", "4,120"] == (1, "Clay — 2031: 4,120", 1) and got["traced", "26,445"] == (2, "Sold — (26,445) | 14,120", 0)


def test_expected_locations(tables):
    got = {(r["id"], r["value"]): (r["location"], r["positions"], r["markers"] and [tuple(m) for m in r["markers"]]) for r in G.expected_locations(*tables).collect()}
    assert got == {
        ("traced", "26,445"): ("excerpt", [2], None),
        ("none", "Leeds"): ("excerpt", [1], None),
        ("no round", "9,127,168"): ("derived", None, [("9,127,167", 1)]),
        ("sum", "30"): ("derived", None, [("Cups 10", 1), ("Bowls 20", 2)]),
        ("invented", "78"): ("missed", None, None),
        ("asked", "12"): ("missed", None, None),
        ("half", "x"): ("missed", None, None),
    }


def test_windows(spark):
    long = "a " * 100 + "figure 4,120 " + "b " * 100
    df = spark.createDataFrame([("short 4,120", "4,120"), (long, "4,120"), (long, "9"), ("7 " + "c " * 100, "7")], "line string, figure string")
    got = [r[0] for r in df.select(T.line_window(F.col("line"), F.col("figure"))).collect()]
    assert got[0] == "short 4,120" and "4,120" in got[1] and got[1].startswith("...") and got[1].endswith("...") and len(got[1]) == 166
    assert got[2].startswith("a a") and got[3].startswith("7 c")
