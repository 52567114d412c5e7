"""Each stage of the pipeline on rows with clashing columns, nulls and repeats, and the whole on the small tables."""

from __future__ import annotations

from collections import defaultdict

import corpus_pipeline as P
from ledgerloom.llm import bpe, langid, packing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = {"score": "1", "toxic": "'x'", "_id": "2", "_text": "'t'", "_spans": "3", "row": "4", "id": "5", "lang_pred": "6"}
    odd = docs.selectExpr("*", *(f"{v} as {k}" for k, v in more.items()))
    extra = spark.createDataFrame([(9001, None, "en", "s", 7), (9002, "", "en", "s", 0), (9003, "token=abcdefgh and words", "en", "s", 24), (9003, "token=abcdefgh and words", "en", "s", 24)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.unionByName(extra.selectExpr("*", *(f"{v} as {k}" for k, v in more.items())))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert len(rows) <= odd.count() and all((r["score"], r["toxic"], r["_spans"], r["row"], r["id"]) == (1, "x", 3, 4, 5) for r in rows), name
        assert stage(spark, odd.where("false"), SF).count() == 0, name
    kept = {r["doc_id"] for r in P.identify_language(spark, odd, SF).collect()}
    assert not kept & {9001, 9002} and len(kept) >= 50
    redacted = {r["doc_id"]: r for r in P.redact_secrets(spark, odd, SF).collect()}
    assert (redacted[9003]["text"], redacted[9003]["n_chars"]) == ("[SECRET] and words", 18)
    assert (redacted[9001]["text"], redacted[9001]["n_chars"]) == (None, 7)


def test_one_id_with_two_texts_loses_neither(spark):
    a = " ".join(f"one{k}" for k in range(60))
    near, other = a + " more", " ".join(f"other{k}" for k in range(60))
    for second in (near, near + " still"):  # whichever digest is the smaller
        docs = spark.createDataFrame([(1, a, "en"), (2, second, "en"), (2, other, "en")], "doc_id long, text string, lang string")
        assert sorted((r["doc_id"], r["text"]) for r in P.drop_near_copies(spark, docs, SF).collect()) == [(1, a), (2, other)]


def test_near_copies_are_searched_by_fingerprint_before_the_prefix_filter(spark, monkeypatch):
    base = [[f"t{k}w{j}" for j in range(n)] for k, n in ((1, 1000), (0, 40))]
    texts = [" ".join(x) for b in base for x in (b, [*b[:-1], "changed"])]
    apart = [(simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())) & (1 << 64) - 1 for a, b in (texts[:2], texts[2:])]
    assert apart[0].bit_count() <= 2 < apart[1].bit_count()  # only one of the two copies is within the operator's radius
    asked, jaccard = [], simhash._jaccard
    monkeypatch.setattr(simhash, "_jaccard", lambda pairs, sets: asked.append(pairs.count()) or jaccard(pairs, sets))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in P.drop_near_copies(spark, docs, SF).collect()) == [0, 2]
    assert asked == [1, 1]


def test_workers_get_small_batches(spark, monkeypatch):
    slices = bpe.slices

    def checked(batch, column):
        assert batch.nbytes < 3_000_000, "a worker got a large batch"
        return slices(batch, column)

    for module in (langid, toxicity, simhash, packing):
        monkeypatch.setattr(module, "slices", checked)
    rows = spark.range(0, 300, 1, 1).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 2000), x -> concat('word', id * 2000 + x))) as text")  # 5 MB in one task
    for name, stage in P.STAGES:
        spark.conf.unset(P.BATCH_BOUND)
        assert {r["doc_id"] for r in stage(spark, rows.selectExpr("*", "'en' as lang"), SF).select("doc_id").collect()} == set(range(300)), name


def test_run(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in P.run(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() <= docs.keys() and len(pieces) >= 0.6 * len(docs)
    for rows in pieces.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == rows[0]["doc_tokens"]
    texts = [docs[i]["text"] for i in pieces]
    assert len(texts) == len(set(texts))
