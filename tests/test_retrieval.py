"""Vector search in blocks, ties of fused lists, needles and judge scores, on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import retrieval as R


def nearest(questions, chunks, k, same=False, by=False):
    out = []
    for q, company, w in questions:
        rows = []
        for key, label, v in chunks:
            if v is None or w is None or any(x is None or not np.isfinite(x) for x in (*v, *w)) or len(v) != len(w) or not len(v):
                continue
            length = np.sqrt(np.dot(v, v)) * np.sqrt(np.dot(w, w))
            if length and (not same or company == label):
                rows.append((round(1 - float(np.dot(v, w)) / length, 9), key, label))
        for kind in {r[2] for r in rows} if by else [None]:
            own = sorted(r[:2] for r in rows if not by or r[2] == kind)[:k]
            out += [(q, kind, key, d, n) if by else (q, key, d, n) for n, (d, key) in enumerate(own, 1)]
    return sorted(out)


def test_vectors_in_blocks(spark):
    rng = np.random.default_rng(7)
    chunks = [(k, k % 3, [float(x) for x in rng.integers(-3, 4, 4)]) for k in range(120)]
    chunks += [(200, 0, None), (201, 0, [1.0, None, 0.0, 0.0]), (202, 1, [float("nan")] * 4), (203, 1, [0.0] * 4), (204, 1, [1.0, 2.0]), (205, 2, [])]
    questions = [(q, q % 3, chunks[q * 7][2]) for q in range(9)] + [(50, 1, None), (51, 1, [1.0, 1.0])]
    asked = spark.createDataFrame(questions, "question_id long, company int, q array<double>")
    held = spark.createDataFrame(chunks, "key long, label int, v array<double>")
    for how in ({}, {"group": 10, "batch": 4}):
        assert sorted(map(tuple, R.vector_topk(asked, held, 6, **how).collect())) == nearest(questions, chunks, 6)
        assert sorted(map(tuple, R.vector_topk(asked, held, 6, same=(("company", "label"),), **how).collect())) == nearest(questions, chunks, 6, same=True)
        assert sorted(map(tuple, R.vector_topk(asked, held, 2, by="label", **how).collect())) == nearest(questions, chunks, 2, by=True)
    assert R.vector_topk(asked.limit(0), held, 6).count() == R.vector_topk(asked, held.limit(0), 6).count() == 0


def test_ties_of_fused_lists_keep_the_order_of_sight(spark):
    rows = [[(1, 1, 1), (1, 3, 2), (1, 4, 3), (2, 7, 1), (3, 1, 1), (3, 2, 2)], [(1, 2, 1), (1, 3, 2), (1, 5, 3), (2, 8, 1), (2, 7, 2), (3, 2, 1), (3, 1, 2)]]
    found = R.fuse([spark.createDataFrame(x, "question_id int, key int, rank int") for x in rows], 99).select("question_id", "key", "rank").collect()
    assert sorted(map(tuple, found)) == [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 4), (1, 5, 5), (2, 7, 1), (2, 8, 2), (3, 1, 1), (3, 2, 2)]


def test_needles_are_found_where_they_are(spark):
    needles = [(1, "fired twice in ovens"), (2, "red"), (3, "two words"), (4, "never said at all"), (5, "ce in ov"), (6, " in ")]
    chunks = [(1, "Tiles fired twice in ovens."), (2, "red\ntwo words here"), (3, "once in ovens"), (4, None)]
    got = E.holders(spark.createDataFrame(needles, "question_id int, needle string"), spark.createDataFrame(chunks, "key int, content string"))
    assert sorted((r["question_id"], r["key"]) for r in got.collect()) == sorted((q, k) for q, n in needles for k, c in chunks if c and n in c)


SCORES = {
    "My rating is 4.": 4, "3 out of 5": 3, "Score: **4**": 4, "So the metric should be 5": 5, "I would rate it as 2 stars.": 2, "score is 2. On reflection the score is 3": 3, "Good.\n\n4": 4, "4  close enough": 4,
    "It cost $4 million": None, "the score is 4.5": None, "4% off": None, "rated at 1": 1, "value = 5": 5, "": None, "a rating of 6": None, "5/5": 5,
}


def test_scores_of_judges(spark):
    got = spark.createDataFrame([(r,) for r in SCORES], "r string").select("r", T.judge_score(F.col("r")).alias("s")).collect()
    assert {r["r"]: r["s"] for r in got} == SCORES
    errors = [("Failed to parse from the following text: Score: 2", 2), ("Score: 2", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame(errors, "e string, s int").select(T.recovered_score(F.col("e"))).collect()] == [s for _, s in errors]


@pytest.mark.parametrize(("filings", "want"), [([], ["company:none"]), (None, ["company:none"]), (["A-1.html", "B-2.html"], ["company:A", "company:B"])])
def test_tags(spark, filings, want):
    df = spark.createDataFrame([("figure", ["30"], ["10", "20"], None, filings, None, "")], "k string, e array<string>, i array<string>, t array<string>, f array<string>, s string, v string")
    tags = df.select(E.question_tags(*map(F.col, df.columns))).first()[0]
    assert tags == ["kind:figure", "calculation", *want, "statement:none"]


def test_texts_are_split_once_for_postings_and_once_for_lengths(spark):
    read, rows = spark.sparkContext.accumulator(0), [(1, "Clay kilns, clay."), (2, "Glass"), (3, "clay glass glass and more"), (4, None), (5, ""), (2, "clay")]

    def counted(row):
        read.add(1)
        return row

    chunks = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(counted), "k long, text string")
    terms = spark.createDataFrame([(7, "clay"), (7, "glass"), (8, "kilns"), (9, "none")], "question_id long, term string")
    index = R.postings(chunks, "k", "text", only=terms)
    got = [(r["question_id"], r["key"], r["rank"]) for r in R.bm25(terms, index, R.lengths(chunks, "k", "text"), 5).collect()]
    assert read.value == 2 * len(rows)
    plain = spark.createDataFrame(rows, "k long, text string")
    whole = [(r["question_id"], r["key"], r["rank"]) for r in R.bm25(terms, R.postings(plain, "k", "text"), R.lengths(plain, "k", "text"), 5).collect()]
    assert sorted(got) == sorted(whole) and {g[0] for g in got} == {7, 8}
    assert {r["term"] for r in index.collect()} == {"clay", "glass", "kilns"}
