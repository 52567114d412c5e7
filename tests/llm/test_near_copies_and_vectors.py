"""MinHash near-duplicates, hard negatives and vector codes against brute force, on the small tables and on awkward rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import lloyd, minhash, negatives, queries
from tests.llm.test_queries import SF, at, documents, odd  # noqa: F401


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {b" ".join(words[k : k + 2]) for k in range(len(words) - 1)} or {b" ".join(words)} - {b""}


def components(texts, percent=80):
    """(set size, least place reachable) of each text: every pair that shares a shingle is compared."""
    sets, root, where = [shingles(t) for t in texts], list(range(len(texts))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for x in s:
            where[x].append(i)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_minhash(spark, at):  # noqa: F811
    docs = documents(spark, at)
    order = sorted(docs)
    expected = {i: (n, order[c], order[c] == i) for i, (n, c) in zip(order, components([docs[i] for i in order]), strict=True)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op11_minhash(spark, at).collect()}
    assert got == expected


def groups(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, **how).collect()}


def test_crowded_buckets_lose_no_link(spark):
    """Templated texts below the similarity, chains of edits and copies, with buckets that count as crowded from three texts on."""
    rng, template = np.random.default_rng(5), [f"t{k}" for k in range(60)]
    texts = [" ".join([*template, *(f"w{i}x{k}" for k in range(14))]) for i in range(40)]
    chain = [f"c{k}" for k in range(80)]
    for i in range(30):
        chain = [f"e{i}" if k == i * 2 % 80 else w for k, w in enumerate(chain)]
        texts += [" ".join(chain)] * (1 + i % 2)
    for _ in range(40):
        own = list(template)
        for k in rng.integers(0, 60, 3):
            own[k] = "z"
        texts.append(" ".join(own))
    expected = {i: c for i, (_, c) in enumerate(components(texts))}
    for how in ({}, {"cap": 2, "pivots": 1, "block": 16}):
        assert groups(spark, texts, **how) == expected, how


def test_similarity_is_whole_numbers(spark):
    """Exactly 80 % links, a shingle less does not."""
    words = [f"a{k}" for k in range(41)]  # 40 shingles
    assert groups(spark, [" ".join(words), " ".join(words[:33])]) == {0: 0, 1: 0}
    assert groups(spark, [" ".join(words), " ".join(words[:32])]) == {0: 0, 1: 1}


def test_ids_that_are_null_or_repeat(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "other words here"), (None, "alone it is"), (None, None), (2, None), (2, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True), (2, 2, True), (2, 2, True)], key=repr)


def test_universal_minima_agree_as_often_as_sets_are_similar():
    factors, addends = minhash.universal(2000)
    a, b = np.arange(1, 101), np.arange(21, 121)
    spread = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    agree = (minhash.minima(spread(a), factors, addends) == minhash.minima(spread(b), factors, addends)).mean()
    assert abs(agree - 80 / 120) < 0.05


def test_connecting_spans_what_pairs_span():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 14, 9)) for _ in range(25)] for _ in range(2))
    near = {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
    found = minhash.connecting(left, right, 80, width=5)
    assert near and set(found) <= near and len(found) < 50

    def parts(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for i, j in edges:
            root[find(("l", i))] = find(("r", j))
        return {frozenset(y for y in list(root) if find(y) == find(x)) for x in list(root)}

    assert parts(found) == parts(near)
    assert minhash.connecting([np.zeros(0, np.int64)], [np.arange(3)], 80) == []


def rows_of(spark, at):  # noqa: F811
    return [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]


def finite(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def weights(v):
    return [int(np.floor(256 * float(x))) for x in v]


def mined(rows, anchors, positives=5, negatives=3):
    """(anchor_id, positive_id, rank, negative_id, positive score, negative score) by comparing all."""
    out = []
    own = [(i, c, weights(v)) for i, c, v in rows if i is not None and c is not None and finite(v)]
    for i, c, w in own:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(w, x, strict=False)), j, d) for j, d, x in own)
        for s, j, _ in [x for x in scored if x[2] == c and x[1] != i][:positives]:
            window = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def test_negatives(spark, at):  # noqa: F811
    shifted = [(i, (c + 1) % 10 if i is not None and c is not None and i % 7 == 0 else c, v) for i, c, v in rows_of(spark, at)]
    expected = mined(shifted, lambda i: i % 50 == 0)
    assert sorted(map(tuple, queries.op12_negatives(spark, at).collect())) == expected and (expected or at != SF)


@pytest.mark.parametrize("scale", [256, 2**40])
def test_negatives_in_many_small_blocks(spark, scale):
    """Blocks of a few rows, chunks of three components, equal scores, large numbers, labels of one kind for most rows."""
    rng = np.random.default_rng(1)
    rows = [(i, 0 if i % 3 else int(rng.integers(1, 4)), [float(x) for x in rng.integers(-4, 9, 8 - i % 2) / 8]) for i in range(80)]
    rows += [(80 + i, 1, rows[i][2]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.mine(df, df["vec_id"] % 5 == 0, scale=scale, group=16, batch=4, chunk=3).collect()
    own = [(i, c, [x * scale / 256 for x in v]) for i, c, v in rows]
    expected = [r if max(r[4], r[5]) < 2**63 else (*r[:4], None, None) for r in mined(own, lambda i: i % 5 == 0)]
    key = lambda r: r[:4]
    assert sorted((tuple(r) if r[4] is not None and r[5] is not None else (*tuple(r)[:4], None, None) for r in got), key=key) == sorted(expected, key=key)


def test_packed_integers():
    for a in (np.array([0, -1, 5, 2**40, -(2**62)]), np.zeros(0, np.int64), np.array([-3, 2]), np.array([10**30, -4], object)):
        assert negatives.unpacked(negatives.packed(a), -1 if len(a) else 0).tolist() == a.tolist()
    assert len(negatives.packed(np.arange(-128, 128))) == 257


def coded(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label) of each row and the codebooks, by plain loops."""
    own = [(i, c, weights(v)) for i, c, v in rows if finite(v)]
    wide = -(-max((len(w) for *_, w in own), default=0) // parts) * parts
    d = wide // parts
    own = [(i, c, w + [0] * (wide - len(w))) for i, c, w in own]
    order = sorted(own, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[r[2][p * d : (p + 1) * d] for r in order] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(w[p * d : (p + 1) * d], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for *_, w in own]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [w[p * d : (p + 1) * d] for (*_, w), f in zip(own, found, strict=True) if f[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f), c) for (i, c, _), f in zip(own, assign(), strict=True)], books


def test_codes(spark, at):  # noqa: F811
    expected, books = coded(rows_of(spark, at))
    label = Counter()
    for *_, e, c in expected:
        label[c] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((i, code, e, label[c], digest) for i, code, e, c in expected)
    assert sorted(map(tuple, queries.op13_codes(spark, at).collect())) == want


def test_codes_of_large_numbers_and_odd_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 40, i % 3, [float(x) for x in rng.normal(size=7 - i % 2)]) for i in range(60)]
    for factor in (1.0, 1e30):
        own = [(i, c, [x * factor for x in v]) for i, c, v in rows]
        found, books = lloyd.encode(spark.createDataFrame(own, "vec_id long, label int, embedding array<double>"), parts=3, entries=5, rounds=3)
        scaled = [(i, c, [int(np.floor(256 * x)) if factor == 1.0 else int(256 * x) for x in v]) for i, c, v in own]
        want, plain = coded([(i, c, [x / 256 for x in v]) for i, c, v in scaled], 3, 5, 3) if factor == 1.0 else (None, None)
        got = sorted((r["vec_id"], "".join(f"{k:02x}" for k in r["code"]), r["error"]) for r in found.collect())
        if want is not None:
            assert got == sorted(r[:3] for r in want) and books.tolist() == plain
        else:
            assert len(got) == 60 and all(e is None for *_, e in got)


def test_only_changed_parts_are_shuffled(spark):
    """From the second round on, the sums are those of the assignments, though only changes were sent."""
    rows = spark.range(500).selectExpr("id", "cast(null as int) as label", "array(cast(id % 17 as double), cast(id % 5 as double)) as v", "cast(null as binary) as code")
    books = np.array([[[256 * 1], [256 * 9]], [[0], [512]]], object)
    first = lloyd._assign(rows, books, 2, 256).cache()
    moved = np.array([[[256 * 3], [256 * 12]], [[0], [512]]], object)
    second = lloyd._assign(first.select("id", "label", "v", "code"), moved, 2, 256).cache()
    total = lambda df: {(r["part"], r["entry"]): (r["n"], tuple(map(int, r["s"]))) for r in df.groupBy("part", "entry").applyInArrow(lloyd._added, lloyd._SUMS).collect()}
    a, delta = lloyd._deltas(first, 2, 2, 2, 256), lloyd._deltas(second, 2, 2, 2, 256)
    assert {r["part"] for r in delta.collect()} == {0}  # nothing of the second part changed
    whole = second.select("id", "label", "v", "code").withColumn("was", second["code"].substr(1, 0).cast("binary")).selectExpr("id", "label", "v", "cast(null as binary) as was", "code")
    assert total(a.union(delta)) == total(lloyd._deltas(whole, 2, 2, 2, 256))
