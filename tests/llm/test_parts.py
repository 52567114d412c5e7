"""Parts of the operators on their own, against plain versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import gph, packing, secrets, sharding, toxicity
from ledgerloom.llm.fingerprint import Sampler
from ledgerloom.llm.topk import block_topk, topk
from ledgerloom.llm.warc import LoserTree


def test_loser_tree_merges_runs_in_order():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randrange(50), i, j) for j in range(rng.randrange(9))) for i in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_differencing_places_every_size_and_is_near_equal():
    rng = random.Random(2)
    for n, m in ((0, 3), (1, 3), (40, 4), (500, 16)):
        sizes = [rng.randrange(1, 500) for _ in range(n)]
        window = packing.differencing(sizes, m)
        totals = np.bincount(window, sizes, m) if n else np.zeros(m)
        assert len(window) == n and totals.sum() == sum(sizes)
        if n >= 10 * m:
            assert totals.max() - totals.min() <= 10


def test_windows_rise_when_capacity_is_exceeded():
    window = packing.balanced([6, 6, 6], 10)
    assert max(np.bincount(window, [6, 6, 6])) <= 10 and len(set(window)) == 3


def test_blocks_of_very_short_documents_are_bounded_and_full():
    packer = packing.Packer(64, 16, 8, 2, most=100)
    rows, longest = [], 0
    for doc in range(1000):
        rows += packer.add(doc, b"\x02\0\0\0" * (1 + doc % 2))
        longest = max(longest, len(packer.pieces))
    rows += packer.flush()
    used = defaultdict(int)
    for _, _, size, _, _, window, offset in rows:
        assert used[window] == offset
        used[window] += size
    assert longest <= 100 and sorted(r[0] for r in rows) == list(range(1000))
    assert max(used.values()) <= 64 and sum(used.values()) == 1500 and len(used) <= 26


def test_weighted_rendezvous_follows_weights_and_moves_keys_only_into_the_new_shard(spark):
    weights = [1.0, 2.0, 5.0]
    own, grown = sharding.rendezvous(F.col("id"), weights, 2.0)
    rows = spark.range(20_000).select(own.alias("a"), grown.alias("b")).collect()
    share = np.bincount([r["a"] for r in rows]) / len(rows)
    assert np.abs(share - np.array(weights) / 8).max() < 0.015
    assert all(r["a"] == r["b"] or r["b"] == 3 for r in rows)
    assert abs(np.mean([r["b"] == 3 for r in rows]) - 0.2) < 0.015


def test_sampler_agrees_with_a_plain_one_and_with_generalised_jaccard():
    rng = random.Random(3)
    own = Sampler(512, 5000)
    for shared in (10, 30, 60):
        base = [f"w{rng.randrange(40)}" for _ in range(200)]
        other = base[: 3 * shared] + [f"v{rng.randrange(40)}" for _ in range(200 - 3 * shared)]
        a, b = (own.samples(" ".join(x)) for x in (base, other))
        count = lambda x: {t: x.count(t) for t in x}
        p, q = count(base), count(other)
        terms = p.keys() | q.keys()
        jaccard = sum(min(p.get(t, 0), q.get(t, 0)) for t in terms) / sum(max(p.get(t, 0), q.get(t, 0)) for t in terms)
        assert abs(float(np.mean(a == b)) - jaccard) < 0.08
        assert (a == Sampler(512, 7).samples(" ".join(base))).all()  # a table that holds few terms changes nothing


def test_thresholds_have_the_sum_and_the_least_cost():
    rng = random.Random(4)
    for _ in range(20):
        table = [[0.0, *sorted(rng.random() * 9 for _ in range(3))] for _ in range(4)]
        total = rng.randrange(-4, 5)
        best = min((sum(r[t + 1] for r, t in zip(table, ts, strict=True)) for ts in np.ndindex(4, 4, 4, 4) for ts in [tuple(t - 1 for t in ts)] if sum(ts) == total), default=math.inf)
        cost, chosen = gph.allocate(table, total)
        assert cost == pytest.approx(best) and (math.isinf(best) or sum(chosen) == total)


def entropy(text, window=20):
    best = -1.0
    for i in range(len(text) - window + 1):
        part = text[i : i + window]
        best = max(best, -sum(part.count(c) / window * math.log2(part.count(c) / window) for c in set(part)))
    return best


def test_entropy_of_windows(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice(secrets.ALPHABET[:n]) for _ in range(k)) for n in (1, 3, 16, 67) for k in (0, 5, 20, 21, 60, 400)]
    found = spark.createDataFrame([(v,) for v in values], "v string").select("v", F.expr(secrets.top_entropy("v")).alias("e")).collect()
    assert all(abs(r["e"] - entropy(r["v"])) < 1e-9 for r in found)


def test_entropy_spans_and_redaction(spark):
    rng = random.Random(6)
    key = "".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(28)) + "a1"
    texts = {
        1: f"look {key} here", 2: f"/sample/{key}", 3: "f47ac10b-58cc-4372-a567-0e02b2c3d479", 4: "some/very/long/path/of/words/part_12", 5: "example-placeholder-00000-12345-x1",
        6: f"token=abcdefgh {key} password: hunter22", 7: f"{'0123456789abcdef' * 2}/{key}", 8: None, 9: "", 10: f"ä{key}é" * 3, 11: "g" * 60 + "1",
    }
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, _base int, _text string")
    rows = secrets.scan(docs).withColumn("clean", secrets.redacted("text")).collect()
    assert all((r["_base"], r["_text"]) == (1, "x") for r in rows)
    got = {r["doc_id"]: ([(s["start"], secrets.KINDS[s["kind"]], s["end"]) for s in r["_spans"]], r["clean"]) for r in rows}
    assert got[1] == ([(5, "entropy", 35)], "look [SECRET] here")
    assert [k for _, k, _ in got[2][0]] == ["entropy"]
    assert {i: got[i] for i in (3, 4, 5, 8, 9, 11)} == {i: ([], texts[i]) for i in (3, 4, 5, 8, 9, 11)}
    assert got[6][1] == "[SECRET] [SECRET] [SECRET]"
    assert [k for _, k, _ in got[7][0]] == ["hex", "entropy"] and got[7][0][1][0] == 32  # what the base span leaves of the candidate
    assert got[10][1] == "ä[SECRET]é" * 3
    for i, (spans, clean) in got.items():
        t, at, out = texts[i] or "", 0, []
        for start, _, end in spans:
            if start >= at:
                out += [t[at:start], "[SECRET]"]
            at = max(at, end)
        assert (clean or "") == "".join(out) + t[at:]


def test_cut_separates_the_classes_best():
    assert 0.3 < toxicity.best_cut(np.array([0.1, 0.2, 0.3, 0.4, 0.9]), np.array([0, 0, 0, 1, 1])) <= 0.4
    assert 0.6 < toxicity.best_cut(np.array([0.1, 0.6, 0.2, 0.7]), np.array([0, 0, 1, 1])) < 0.7  # of two equal cuts the one that spares more
    assert toxicity.best_cut(np.array([0.2, 0.2, 0.2]), np.array([0, 1, 0])) == 0.5
    assert toxicity.best_cut(np.array([0.9, 0.1]), np.array([0, 1])) == 0.5
    assert toxicity.best_cut(np.array([]), np.array([])) == 0.5


def test_finite_vectors_of_any_size(spark):
    rows = [(0, [3e8, 0.0]), (1, [0.0, 3e8]), (2, [1e13, 1.0]), (3, [1e-3, 2.0]), (50, [1.5, 2.0]), (50, [-1.5, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk(vectors.where("vec_id = 50"), vectors).collect())
    weights = [(i, [math.floor(256 * x) if abs(x) < 2**52 else 256 * int(x) for x in v]) for i, v in rows]
    expected = []
    for i, v in weights:
        if i == 50:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in weights if j != 50)[:5]
            expected += [(50, k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert got == sorted(expected)
    q = np.array([[2**40, 1]], object)
    assert block_topk(q, np.array([9]), np.array([[2**40, 0], [-(2**40), 5]], object), np.array([1, 2]), 2) == [(0, 0, 2**80), (0, 1, 5 - 2**80)]
