"""Checks against facts, trees and other runs, on small fixtures."""

from __future__ import annotations

import datetime

import pytest

from ledgerloom.operators import checks as K

DAY = datetime.date
VALUE = "table string, column string, start date, end date, instant date, dims string, concept string, unit string"


def year(y):
    return DAY(y, 1, 1), DAY(y, 12, 31), None


def instant(y):
    return None, None, DAY(y, 12, 31)


def test_columns_align_by_their_aspect(spark):
    rows = []
    put = lambda t, c, period, dims="", concept="k", unit="USD": rows.append((t, c, *period, dims, concept, unit))
    for y in (2030, 2031):
        for k in range(3):  # years, with opening and closing instants
            put("years", str(y), year(y), concept=f"c{k}")
        put("years", str(y), instant(y), concept="c3")
        put("years", str(y), instant(y - 1), concept="c4")
    for column, dims in (("a", "x"), ("b", "y")):
        put("members", column, year(2030), dims)
        put("members", column, year(2031), dims)
    for column in "abc":
        put("strays", column, year(2030 + "abc".index(column)))
        put("strays", column, year(2030 + ("abc".index(column) if column != "c" else 5)))
    for column, (y, concept) in {"a": (2030, "gross"), "b": (2030, "net"), "c": (2031, "gross"), "d": (2031, "net")}.items():
        put("pairs", column, year(y), concept=concept)
        put("pairs", column, year(y), concept=concept)
    for column in "ab":
        put("same", column, year(2030))
        put("same", column, year(2030))
    put("one", "a", year(2030))
    put("one", "b", year(2030))
    put("one", "b", year(2030))
    found = K.column_alignment(spark.createDataFrame(rows, VALUE)).collect()
    got = {(r["table"], r["column"]): (r["aspect"], r["status"]) for r in found}
    assert got["years", "2030"] == got["years", "2031"] == ("period", "aligned")
    assert got["members", "a"] == ("dims", "aligned")
    assert (got["strays", "a"], got["strays", "c"]) == (("period", "aligned"), ("period", "misaligned"))
    assert got["pairs", "a"] == got["pairs", "d"] == ("period+concept", "aligned")
    assert got["same", "a"] == ("period", "indistinct")
    assert got["one", "a"] == got["one", "b"] == (None, "not checkable")
    assert K.column_alignment(spark.createDataFrame([], VALUE)).count() == 0


def test_ancestors_of_a_tree_a_chain_and_a_circle(spark):
    chain = [("r", f"n{k}", f"n{k + 1}") for k in range(20)] + [("s", "a", "b"), ("s", "b", "a"), ("s", None, "x")]
    found = {(r["role"], r["node"], r["ancestor"]) for r in K.ancestors(spark.createDataFrame(chain, "role string, child string, parent string")).collect()}
    assert {x for x in found if x[0] == "r"} == {("r", f"n{i}", f"n{j}") for i in range(20) for j in range(i + 1, 21)}
    assert {x for x in found if x[0] == "s"} == {("s", a, b) for a in "ab" for b in "ab"}


def test_groups_against_the_tree(spark):
    parents = [("r", c, "Wares") for c in ("cups", "bowls", "jugs", "late")] + [("r", "Wares", "All"), ("r", "rent", "Costs"), ("r", "Costs", "All"), ("r", "deep", "Sub"), ("r", "Sub", "Wares"), ("r", "sum", "All"), ("r", "p", "X LineItems"), ("r", "q", "X LineItems"), ("s", "cups", "Other")]
    tables = {
        "inside": [("Wares:", "cups"), ("Wares:", "bowls"), ("Wares:", "rent")], "fine": [("Wares:", "cups"), ("Wares:", "bowls"), ("Wares:", "deep"), ("Wares:", "sum"), (None, "rent")],
        "outside": [("Wares:", "cups"), ("Wares:", "bowls"), (None, "late"), (None, "rent")], "flat": [(None, "jugs"), ("Wares:", "cups"), ("Wares:", "bowls"), (None, "late")],
        "twofold": [("A", "cups"), ("A", "bowls"), ("B", "cups"), ("A", "rent")], "lines": [("A", "p"), ("A", "q"), ("A", "rent")], "few": [("Wares:", "cups"), ("Wares:", "unknown")],
    }
    rows = [(t, k, "Total x" if c == "sum" else "x", g, c) for t, own in tables.items() for k, (g, c) in enumerate(own)]
    found = K.group_disagreements(spark.createDataFrame(rows, "table string, row int, label string, grp string, concept string"), spark.createDataFrame(parents, "role string, child string, parent string"))
    got = {(r["table"], r["row"], r["kind"], r["parent"], r["shared"]) for r in found.collect()}
    assert got == {("inside", 2, "inside", "Costs", "Wares"), ("outside", 2, "outside", "Wares", "Wares")}


def test_runs_on_common_questions(spark):
    rows = [
        ("Main.1", "a", "x’s", "1", "g"), ("Main.1", "b", "x's", "1", "g"), ("Main.2", "a", "x", "1", "g"), ("Main.2", "b", "y", "1", "g"), ("Held.3", "a", "x", "1", "g"), ("Held.3", "b", "x", "2", "g"),
        ("Held.4", "a", "x", "1", "g"), ("Held.4", "b", "y", "2", "h"), ("Held.5", "a", "x", "1", "-"), ("Held.5", "b", "x", "1", "h"), ("Main.6", "a", "x", "1", "g"), ("Main.1", "b", "z", "1", "g"),
    ]
    df = spark.createDataFrame(rows, "scenario string, execution string, text string, figures string, grade string")
    aligned = K.in_every_execution(df)
    assert {r["scenario"] for r in aligned.collect()} == {"Main.1", "Main.2", "Held.3", "Held.4", "Held.5"} and aligned.count() == 10
    assert K.in_every_execution(df, ["a", "b", "c"]).count() == 0 and K.in_every_execution(df, ["a"]).count() == 6
    from pyspark.sql import functions as F

    counts = {r["qset"]: tuple(r)[1:] for r in K.variation_counts(aligned, F.split("scenario", r"\.")[0]).collect()}
    assert counts == {"Main": (2, 1, 1, 0, 0), "Held": (3, 1, 0, 1, 1), "All": (5, 2, 1, 1, 1)}
    assert [tuple(r) for r in K.pairs_alike(aligned).collect()] == [("a", "b", 5, 3, 4, 3)]


def test_gates_stop_the_job(spark):
    stored = spark.createDataFrame([("r", "1", "wrong"), ("r", "2", "reliable")], "run string, id string, grade string")
    now = spark.createDataFrame([("r", "1", "wrong"), ("r", "2", "reliable")], "run string, id string, status string")
    assert K.regraded(stored, now, ["run", "id"]).count() == 2 and len(K.regraded(stored, now, ["run", "id"]).collect()) == 2
    other = spark.createDataFrame([("r", "1", "wrong"), ("r", "2", "check")], "run string, id string, status string")
    with pytest.raises(Exception, match="graded check on import, reliable when it ran: r.2"):
        K.regraded(stored, other, ["run", "id"]).collect()
    with pytest.raises(Exception, match="graded nothing"):
        K.regraded(stored, now.limit(1), ["run", "id"]).collect()
    questions = spark.createDataFrame([("H1", None), ("H2", "q")], "id string, question string")
    assert {r["id"] for r in K.only(questions, spark.createDataFrame([("H1",), ("H1",)], "id string")).collect()} == {"H1"}
    with pytest.raises(Exception, match="unknown id H9"):
        K.only(questions, spark.createDataFrame([("H1",), ("H9",)], "id string")).collect()
