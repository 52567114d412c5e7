"""Stems against the values of the published algorithm, the stemmed index against a plain count, encoder input."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions.stems import encoder_words, pair_ids, stem, stemmed_words, stems
from ledgerloom.operators import retrieval as R

GOLDEN = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration digitizer digit conformabli conform radicalli radic differentli differ vileli vile vietnamization vietnam
predication predic operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic
formative form formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ
angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "root"), list(zip(GOLDEN[::2], GOLDEN[1::2], strict=True)))
def test_stems(word, root):
    assert stem(word) == root


def test_words_of_a_text():
    assert stems("Éarnings_per share, as 2,5") == ["earn", "per", "share", "as", "2", "5"] and stems(None) == stems("") == []
    assert stem("as") == "as" and stem("s" * 65) == "s" * 65


def test_stemmed_index_finds_other_forms(spark):
    texts = [(1, "Repurchased shares"), (2, "the repurchases of a share, shares"), (3, None), (4, "")]
    chunks = spark.createDataFrame(texts, "k long, text string")
    index = R.postings(chunks, "k", "text", stemmed_words)
    wanted = Counter((s, k) for k, t in texts for s in stems(t))
    assert {(r.term, r.key): r.tf for r in index.collect()} == wanted
    asked = spark.createDataFrame([(7, "repurchasing")], "question_id long, q string").select("question_id", F.explode(stemmed_words(F.col("q"))).alias("term"))
    found = R.bm25(asked, index, R.lengths(chunks, "k", "text", stemmed_words), 5).collect()
    assert {r.key for r in found} == {1, 2}


def test_encoder_input(spark):
    assert encoder_words("Café's\x00\t50% 中文a b\x07c") == ["cafe", "'", "s", "50", "%", "中", "文", "a", "bc"]
    df = spark.createDataFrame([([1, 2], list(range(10, 20)))], "q array<int>, p array<int>")
    row = df.select(pair_ids(F.col("q"), F.col("p"), 101, 102, 9).alias("x")).first().x
    assert (row.ids, row.types) == ([101, 1, 2, 102, 10, 11, 12, 13, 102], [0, 0, 0, 0, 1, 1, 1, 1, 1])
    assert df.select(pair_ids(F.col("q"), F.col("p"), 101, 102).alias("x")).first().x.ids == [101, 1, 2, 102, *range(10, 20), 102]
    with pytest.raises(PySparkException):
        df.select(pair_ids(F.col("q"), F.col("p"), 101, 102, 4)).collect()
