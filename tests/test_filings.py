"""Sections, chunks, sources and sinks on small fixtures."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import chunking as C
from ledgerloom.operators import sections as S
from ledgerloom.plans import catalogue
from ledgerloom.sources import filings as R

WORDS = lambda text: F.regexp_count(text, F.lit(r"\S+"))


def test_sections(spark):
    text = "Cover\n12\nPART I\nItem 1. Business\nWe do.\n---\nItem 1\nPART I\nSIGNATURES\n```\n#rows\nPART II\n```\nConsolidated Balance Sheets\n| a |\nPART IV\nItem 16.Summary\nNone.\nSIGNATURES\nSigned\nExhibit Index\n"
    docs = spark.createDataFrame([("f", text), ("g", None), ("h", "")], "filing string, text string")
    got = [(r["heading"], r["body"]) for r in S.sections(S.lines(docs)).orderBy("filing", "section").collect()]
    assert got == [
        ("(no heading)", "Cover"), ("PART I > Item 1. Business", "We do.\nSIGNATURES\n```\n#rows\nPART II\n```"), ("PART I > Item 1. Business", "Consolidated Balance Sheets\n| a |"),
        ("PART IV > Item 16. Summary", "None."), ("PART IV > Signatures", "Signed"),
    ]


def chunks(spark, body, budget, overlap, count=WORDS):
    df = spark.createDataFrame([("f", 1, "h", body)], "filing string, section long, heading string, body string")
    return [(r["content"], r["blocks"]) for r in C.chunked(df, budget, overlap, count).orderBy("piece").collect()]


def test_blocks_and_row_blocks(spark):
    body = "one\ntwo\n| a | b |\n|---|---|\nthree\n\n| | |\n|--|--|\n\nfour"
    rows = "```\n#rows\n#context In millions\na — x: 1\nb — x: 2 \n```"
    df = spark.createDataFrame([(body, rows, "plain\ntext\nhere")], "body string, rows string, plain string")
    r = C.with_blocks(df, "body", "b").select("b", C.row_block(F.col("rows")).alias("r"), C.row_block(F.col("plain")).alias("p"), C.format_rows(C.row_block(F.col("rows"))["rows"], F.lit("In millions")).alias("f")).first()
    assert [b["text"] for b in r["b"]] == ["one\ntwo", "| a | b |\n|---|---|", "three", "four"]
    assert (r["r"]["rows"], r["r"]["context"], r["p"]) == (["a — x: 1", "b — x: 2"], "In millions", None)
    assert r["f"] == "#rows\n#context In millions\na — x: 1\nb — x: 2"


def test_header_of_a_pipe_table(spark):
    tables = {
        ("| h | x |", "|---|---|", "| Wares: | |", "| a | $1 |"): 2,
        ("| h | x |", "|---|---|", "| sub | head |", "| a | 1,250 |"): 3,
        ("| h | x |", "|---|---|", "| Wares: | |", "| Year ended | May |", "| a | $1 |"): 4,
        ("| h | x |", "|---|---|", "| | 2031 | 2030 |", "| a | $1 |"): 3,
        ("| h | x |", "|---|---|", "| a | b |"): 2,
    }
    got = spark.createDataFrame([(list(t), n) for t, n in tables.items()], "t array<string>, n int").select("n", C.header_size(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in got] == [r["n"] for r in got]


def test_packing_rules(spark):
    p = lambda n, w="w": " ".join([w] * n)
    overlap = chunks(spark, "\n\n".join([p(6), p(3, "x"), p(5, "y")]), 10, 4)
    assert overlap == [(p(6) + "\n\n" + p(3, "x"), [0, 1]), (p(3, "x") + "\n\n" + p(5, "y"), [1, 2])]
    assert chunks(spark, "\n\n".join([p(6), p(5, "x"), p(5, "y")]), 10, 4) == [(p(6), [0]), (p(5, "x") + "\n\n" + p(5, "y"), [1, 2])]
    table = "\n".join(["| h | 2031 |", "|---|---|", "| Wares: | |", *(f"| row{k} | ${k} |" for k in range(6)), "| Total | $9 |", "| rest | $1 |", "| rest | $2 |"])
    cut = chunks(spark, f"Title\n\n{table}\n\nSee notes", 22, 5)
    assert cut[0][0].startswith("Title\n\n| h | 2031 |\n|---|---|\n| Wares: | |\n| row0") and cut[0][1] == [0, 1] and len(cut) > 2
    assert all(c.startswith("| h | 2031 |\n|---|---|\n") for c, _ in cut[1:]) and cut[-1][0].endswith("\n\nSee notes") and cut[-1][1] == [1, 2]
    assert all(("| Wares: | |" in c) == ("row" in c or "| Total" in c.split("\n")[3]) for c, _ in cut)
    whole = "\n".join(c for c, _ in cut)
    assert all(whole.count(r) == 1 for r in table.split("\n")[3:])
    rows = "```\n#rows\n#context Ctx\nA > a — 1\nA > b — 2\nB > c — 3\nB > d — 4\nB > e — 5\n```"
    assert [c for c, _ in chunks(spark, f"Lead\n\n{rows}", 19, 5)] == ["Lead\n\nCtx\nA > a — 1\nA > b — 2", "Lead\n\nCtx\nB > c — 3\nB > d — 4\nB > e — 5"]
    assert [c for c, _ in chunks(spark, "aa bb cc dd ee", 2, 0)] == ["aa bb", "cc dd", "ee"]
    assert [c for c, _ in chunks(spark, "a-b-c-d e", 2, 0, C.count_tokens)] == ["a-", "b-", "c-", "d e"]
    assert chunks(spark, None, 10, 2) == chunks(spark, "", 10, 2) == chunks(spark, " \n \n| |", 10, 2) == []


def test_stretches_end_at_breaks():
    assert list(C.fill([3, 3, 3, 3], [True, False, False, False], [0] * 4, 7, 7)) == [(0, 2), (2, 4)]
    assert list(C.fill([3, 3, 3, 3], [True, True, False, True], [0] * 4, 7, 7)) == [(0, 1), (1, 3), (3, 4)]
    assert list(C.fill([9, 1, 1], [True] * 3, [0] * 3, 5, 5)) == [(0, 1), (1, 3)]
    assert list(C.fill([2, 2, 2], [True] * 3, [0, 0, 3], 4, 4)) == [(0, 2), (2, 3)]


def plain_chunks(text, budget, overlap):
    """Paragraphs of a text without tables packed one by one, long ones cut word by word."""
    size = lambda t: len(re.findall(r"\w+|[^\w\s]", t))
    blocks = [b.strip() for b in re.split(r"\n(?:[^\S\n]*\n)+", "\n" + (text or "").replace("\r", " ") + "\n") if b.strip()]
    out, held = [], []
    for b in blocks:
        if held and (size(b) > budget or sum(map(size, held)) + size(b) > budget):
            out.append("\n\n".join(held))
            held = held[-1:] if size(b) <= budget and size(held[-1]) <= overlap else []
        if size(b) <= budget:
            held.append(b)
            continue
        piece = ""
        for word in re.findall(r"\S+\s*", b):
            if piece and size(piece) + size(word) > budget:
                out.append(piece.strip())
                piece = ""
            piece += word
        out.append(piece.strip())
        held = []
    return out + (["\n\n".join(held)] if held else [])


def test_chunks_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = {}
    for r in catalogue.QUERIES["chunk_budget"](spark, sf).orderBy("section", "piece").collect():
        found.setdefault(r["section"], []).append(r)
        assert r["tokens"] <= 200 + C.ATTACHED + 20 or "|" in r["content"]
    compared = 0
    for i, text in texts.items():
        long_word = any(len(re.findall(r"\w+|[^\w\s]", w)) > 200 for w in (text or "").split())
        if not long_word and not re.search(r"(?m)^\s*\|", text or ""):
            assert [r["content"] for r in found.get(i, [])] == plain_chunks(text, 200, 20), i
            compared += 1
    assert compared > 150


def test_sources_and_sinks(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "a.html").write_bytes("<meta charset='windows-1252'>é".encode("cp1252"))
    (folder / "b.html").write_bytes(b"\xef\xbb\xbf<meta charset=latin-1>" + "é".encode())
    (folder / "c.html").write_bytes(b"<meta charset=nonsense>" + "é<IX:HEADER x>hid\nden</ix:header>".encode())
    read = R.read_filings(spark, f"file://{folder}")
    got = {r["filing"]: r["t"] for r in read.select("filing", R.without_hidden_header(F.col("html")).alias("t")).collect()}
    assert {k: v[-1] for k, v in got.items()} == {"a.html": "é", "b.html": "é", "c.html": "é"}
    with pytest.raises(FileNotFoundError):
        R.read_filings(spark, f"file://{folder}", "*.pdf")
    records = spark.createDataFrame([(1, "f", "H", "narrative", "text")], "key int, source_filing string, heading string, statement_type string, content string")
    path = R.index_path(f"file://{tmp_path}", "Structured", "org/model:1", 1000)
    assert path.endswith("/index/structured/org-model-1-1000") and R.write_index(records, path) == 1
    assert [tuple(r) for r in R.read_index(spark, path).collect()] == [("f", "H", "text")]
    with pytest.raises(ValueError, match="start at 1"):
        R.write_index(records.withColumn("key", F.lit(0)), path)
    R.write_review(records, f"file://{tmp_path}/review")
    assert "=== 1 | H | narrative ===" in "\n".join(r[0] for r in spark.read.text(f"file://{tmp_path}/review/*").collect())
    now = R.manifest(read, {"model": "m", "max_tokens": "500"})
    at = f"file://{tmp_path}/manifest"
    assert R.load_manifest(spark, at, now) is None
    R.save_manifest(now, at)
    stored = R.load_manifest(spark, at, now)
    assert R.differences(stored, now).count() == 0
    changed = R.manifest(read.where("filing <> 'a.html'").withColumn("sha256", F.when(F.col("filing") == "b.html", "0").otherwise(F.col("sha256"))), {"model": "n", "max_tokens": "500"})
    assert {r["what"] for r in R.differences(stored, changed).collect()} == {"setting model", "file a.html", "file b.html"}
    (tmp_path / "expected.json").write_text(json.dumps({"questions": [{"id": "H1", "question": "Q one?", "kind": "figure", "expect": ["1"]}, {"id": "H2", "question": "Q two?", "kind": "fact"}]}))
    (tmp_path / "asked.txt").write_text("Q two?\n\n")
    expected = R.read_expected(spark, f"file://{tmp_path}/expected.json")
    assert [r["id"] for r in R.read_questions(spark, f"file://{tmp_path}/asked.txt", expected).collect()] == ["H2"]
    (tmp_path / "other.txt").write_text("Q three?\n")
    with pytest.raises(ValueError, match="three"):
        R.read_questions(spark, f"file://{tmp_path}/other.txt", expected)
    run = tmp_path / "results" / "v1" / "Main.H1"
    run.mkdir(parents=True)
    (run / "1.json").write_text(json.dumps({"scenarioName": "Main.H1", "iterationName": "1", "executionName": "v1", "creationTime": "2026-01-02T03:04:05Z", "evaluationResult": {"metrics": {"Grade": {"value": "reliable", "reason": "r"}}}, "tags": ["Main"]}))
    assert [(r["scenario"], r["metrics"]["Grade"]["value"]) for r in R.read_results(spark, f"file://{tmp_path}/results").collect()] == [("Main.H1", "reliable")]
