"""Each query against a brute-force version of its contract, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import queries, wordbpe

SF = "/root/testdata/sf0.001"
LONG = "Ein langer Text mit Wörtern. " * 9000
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, LONG), (6, "Same text twice over, and again."), (7, "Same text twice over, and again."),
    (8, "a<|endoftext|>b İstanbul ΑΣ é don't 'S x\x1cy \x85 日本語 ½³"), (9, "x" * 30000), (10, "é" * 5000), (11, "123 456 !!!"), (12, "  "),
    (13, 'secret=token:abcdefgh password = "hunter22" AKIA' + "A1" * 9 + " " + "0a" * 15 + " api-key: zzzzzzz é token=12345"), (14, "one two"), (15, "One TWO"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables of awkward rows, with an extra column whose name clashes with those of results."""
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "de" if i % 2 else None, None if i == 4 else "src0", None, "clash", 1) for i, t in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, part int")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (5, 1, 1), (6, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    big = "<p>ä</p>" * 300
    pages = [(1, "http://a.b/c", big), (2, None, big), (3, "http://www.A.b:80/c?x=1", big), (4, "", None), (5, "http://a.b/c", "<p>"), (6, "x", "<p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    vectors = [(0, [1.0, 0.5]), (50, [0.25]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (4, [1.0, 0.5]), (5, [1.0, 0.5]), (6, [-1.0, 2.0]), (7, []), (8, [1.0, 0.5]), (9, [float("inf")])]
    labelled = [(*v, None if v[0] == 5 else v[0] % 2, "clash") for v in vectors]
    spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int, code string").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return at


def documents(spark, at):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{at}/documents.parquet").collect()}


@pytest.fixture(params=["small", "odd"])
def at(request, odd):
    return SF if request.param == "small" else odd


@pytest.mark.parametrize("name", queries.QUERIES)
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def ids_of(text, tokenizer=[]):  # noqa: B006
    if not tokenizer:
        tokenizer.append(Tokenizer.from_file(wordbpe.default_vocabulary()))
    ids = tokenizer[0].encode(text, add_special_tokens=False).ids
    return ids, tokenizer[0].decode(ids, skip_special_tokens=False)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe(spark, at):
    docs = documents(spark, at)
    got = {r["doc_id"]: r for r in queries.op1_bpe(spark, at).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids, decoded = ids_of(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded)), t[:80]


def test_warc(spark, at):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    last = {}
    for i, p in pages.items():
        last[p] = max(i, last.get(p, i))
    rows = queries.op2_warc(spark, at).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        p = pages[r["page_id"]]
        again = len(p) >= 1000 and last[p] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", last[p] if again else None)
    in_order = sorted(rows, key=lambda r: (r["range_no"], r["range_at"]))
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in in_order]
    assert keys == sorted(keys)


def test_sharding(spark, at):
    docs = documents(spark, at)
    rows = queries.op3_sharding(spark, at).collect()
    slots = defaultdict(list)
    for r in rows:
        t = docs[r["doc_id"]].encode()
        u = [(int(hashlib.md5(f"{r['doc_id']}:{k}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12 for k in range(25)]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 8, zlib.crc32(t), "key")
        assert (r["shard"], r["grown_shard"]) == (int(np.argmax(u[:24])), int(np.argmax(u)))
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op4_langid(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_odd(spark, odd):
    got = {r["doc_id"]: r for r in queries.op4_langid(spark, odd).collect()}
    assert len(got) == len(AWKWARD) and {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 11, 12}


def test_fingerprint(spark, at):
    docs = documents(spark, at)
    order = sorted(docs)
    got = {r["doc_id"]: r for r in queries.op5_fingerprint(spark, at).collect()}
    assert got.keys() == docs.keys()
    by_text, errors = defaultdict(set), []
    for k, i in enumerate(order):
        following = docs[order[(k + 1) % len(order)]]
        t, r = docs[i], got[i]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(changed))
        by_text[t].add(r["fingerprint"])
        by_text[changed].add(r["edited_fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        a, b = Counter(t.lower().split()), Counter(changed.lower().split())
        if a and b:
            errors.append(r["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert all(len(v) == 1 for v in by_text.values())
    assert abs(np.mean(errors)) < 0.12 and np.abs(errors).mean() < 0.12


def test_packing(spark, at):
    docs = documents(spark, at)
    pieces, sequences, padding = defaultdict(list), defaultdict(list), 0
    for r in queries.op6_packing(spark, at).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == docs.keys()
    for i, t in docs.items():
        ids, at_token = [*ids_of(t)[0], 2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at_token, len(ids), zlib.crc32(part)) and r["length"] > 0
            at_token += r["length"]
        assert at_token == len(ids)
    for rows in sequences.values():
        at_token = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at_token
            at_token += r["length"]
        assert at_token <= 4096
        padding += 4096 - at_token
    if len(docs) > 50:
        assert padding / (4096 * len(sequences)) < 0.06


BASE = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_secrets(spark, at):
    docs = documents(spark, at)
    got = {r["doc_id"]: r for r in queries.op7_secrets(spark, at).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        found = base_spans(t)
        n = Counter(f[3] for f in found)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (n["assign"], n["access"], n["hex"])
        written = [f"{f[3]}:{f[0]}:{f[2]}" for f in found]
        assert got[i]["base_sha256"] == sha(",".join(written)) and set(written) <= set(got[i]["spans"].split(",")) | {""}


def test_topk(spark, at):
    vectors = {}
    for r in spark.read.parquet(f"{at}/embeddings.parquet").collect():
        v = r["embedding"]
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[r["vec_id"]] = [int(np.floor(256 * float(x))) for x in v]
    expected = []
    for q in (i for i in vectors if i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        expected += [(q, k, i, -s) for k, (s, i) in enumerate(scored[:5], 1)]
    assert sorted(tuple(r) for r in queries.op9_topk(spark, at).collect()) == sorted(expected)


def test_simhash(spark, at):
    docs = documents(spark, at)
    fps = {}
    for i, t in docs.items():
        words = re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())
        runs = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)] * bool(words)
        h = [xxhash.xxh64_intdigest(s, 42) for s in runs]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(docs)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, at).collect()}
    assert got == {i: (f"{fps[i]:016x}", find(i)) for i in docs}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op8_toxicity(spark, sf)
    assert got.count() == 1000
    rows = got.join(labels, "doc_id").collect()
    right = np.mean([r["toxic"] == bool(labels_) for r, labels_ in ((r, r[-1]) for r in rows)])
    assert right > 0.95
    assert all(0 <= r["severity"] <= 2 and (r["grade"] > 0) == r["toxic"] for r in rows)


def test_toxicity_odd(spark, odd):
    assert queries.op8_toxicity(spark, odd).count() == len(AWKWARD)


def test_null_ids_do_not_fail(spark, tmp_path):
    rows = [(None, "text with words", "en"), (None, None, None), (1, "text with words", "en"), (1, "text with words", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None, "x" * 2000), (1, "u", "x" * 2000), (1, "u", "x" * 2000), (2, "u", "x" * 2000)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(None, [1.0], 0), (0, [1.0], 0), (0, [1.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, f in queries.QUERIES.items():
        n = f(spark, str(tmp_path)).count()
        assert n == {"op9_topk": 0, "op12_negatives": 0, "op13_codes": 3}.get(name, 4), name
    kinds = queries.op2_warc(spark, str(tmp_path)).groupBy("record_type").agg(F.count(F.lit(1))).collect()
    assert dict(map(tuple, kinds)) == {"response": 1, "revisit": 3}


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    from tests.oracle import compare

    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == []
