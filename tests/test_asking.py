"""The ask flow on small fixtures: filters of each question, several companies, stems, headings and refusals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.stems import stemmed_words
from ledgerloom.operators import asking as A

CHUNKS = [
    (1, "a", "balance_sheet", "Assets", "Clay and tiles", [1.0, 0.0]), (2, "a", "narrative", "Ovens", "Firing ovens at night", [0.9, 0.1]), (3, "a", "narrative", "Other", "rent", [0.0, 1.0]),
    (4, "b", "balance_sheet", "Assets", "Glazes", [0.8, 0.2]), (5, "b", "narrative", "Ovens", "fired twice", [0.1, 0.9]), (6, "c", "narrative", "Ovens", None, None),
]
QUESTIONS = [
    (1, "What about the oven firing?", [1.0, 0.0], [], None), (2, "oven?", [1.0, 0.0], ["b", "a"], None), (3, "What assets are there?", [0.0, 1.0], ["a"], "balance_sheet"),
    (4, "Compare them", [1.0, 0.0], ["z"], None), (5, "the", None, None, None), (5, "the", None, None, None),
]


def tables(spark):
    questions = spark.createDataFrame(QUESTIONS, "question_id long, question string, q array<double>, filings array<string>, statement_type string")
    return questions, spark.createDataFrame(CHUNKS, "key long, filing string, statement_type string, heading string, content string, v array<double>")


def results(spark, **how):
    out = {}
    for r in A.retrieve(*tables(spark), 4, **how).orderBy("question_id", "result").collect():
        out.setdefault(r["question_id"], []).append((r["filing"], r["key"]))
    return out


def test_each_question_has_its_own_filters(spark):
    got = results(spark)
    assert [k for _, k in got[1]][:1] == [2] and len(got[1]) == 4  # `oven` is no whole word of the texts, `firing` is
    assert got[2] == [("a", 1), ("b", 4), ("a", 2), ("b", 5)]
    assert got[3][0] == ("a", 1) and {k for _, k in got[3]} == {1, 2, 3}  # the statement is a second vote, not a filter
    assert 4 not in got and 5 not in got


def test_stems_and_headings_are_searched(spark):
    got = results(spark, split=stemmed_words)
    assert [k for _, k in got[1]][:2] == [2, 1] or got[1][0] == (None, 2)
    assert got[2][:2] == [("a", 2), ("b", 5)]  # `oven` meets the heading `Ovens`


def test_prompts_and_refusals(spark):
    found = {r["question_id"]: r for r in A.ask(*tables(spark), "Say.\nCite.", 4, 2, 40, count=lambda c: F.size(T.words(c))).collect()}
    assert len(found) == 5 and found[4]["refusal"] == found[5]["refusal"] == "no excerpts"
    assert found[4]["effort"] == "synthesis" and found[1]["effort"] == "lookup"
    assert found[2]["refusal"] is None and found[2]["system"] == "Say.\r\nCite."
    assert found[2]["user"] == "Context excerpts:\n\n--- Excerpt from a, section Assets ---\nClay and tiles\n\n--- Excerpt from b, section Assets ---\nGlazes\n\n\nQuestion: oven?"
    short = {r["question_id"]: r["refusal"] for r in A.ask(*tables(spark), "Say.", 4, 2, 10, count=lambda c: F.size(T.words(c))).collect()}
    assert short[2] == "prompt too long"
    assert A.retrieve(*(df.limit(0) for df in tables(spark)), 4).count() == 0
