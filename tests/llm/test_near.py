"""Near copies of the pipeline: against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import simhash


def altered(words, edits, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.random()}"
    return out


def test_sketches_never_differ_more_than_sets():
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    for edits in range(0, 60, 3):
        a, b = (simhash.shingle_set(" ".join(w).encode()) for w in (base, altered(base, edits, rng)))
        sketches = np.bitwise_xor(simhash.parities(a), simhash.parities(b)).view(np.uint8)
        assert np.unpackbits(sketches).sum() <= len(np.setxor1d(a, b))


def test_near_texts_against_brute_force(spark):
    rng = random.Random(2)
    texts = []
    for size in (1, 2, 5, 40):  # the last has crowded buckets
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(altered(base, k % 6, rng)) for k in range(size)]
    texts += [texts[-1], texts[-1], None, "", "one two"]
    rng.shuffle(texts)
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [set(simhash.shingle_set((t or "").encode()).tolist()) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            union = sets[a] | sets[b]
            if not union or len(sets[a] & sets[b]) >= 0.8 * len(union):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert found == dict(enumerate(group))


def test_fingerprint_pairs_connect_all_within_two_bits(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:30] for _ in range(2)]
    fps += [fps[0] ^ (1 << b) for b in range(64)] * 2 + fps[:10]  # a crowded bucket, and equal ones
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.fingerprint_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, fp long")).collect()
    pairs = [(r["a"], r["b"]) for r in found]
    assert all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))

    def groups(links):
        group = list(range(len(fps)))
        for a, b in links:
            low, high = sorted((group[a], group[b]))
            group = [low if g == high else g for g in group]
        return group

    assert groups(pairs) == groups((a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2)


def test_repeats_are_counted_in_blocks():
    rng = random.Random(6)
    sets = [np.array(sorted({rng.randrange(40) for _ in range(k % 9)}), np.int64) for k in range(50)]
    repeats, found = simhash.Repeats(64), []
    for k, own in enumerate(sets):
        found += [*repeats.add(k, own), *repeats.add(k, own)]  # the second is an equal text
    found.append(repeats.flush())
    flat = np.concatenate(sets)
    wanted = [np.unique(flat[low : low + 64], return_counts=True) for low in range(0, len(flat) + 1, 64)]
    assert len(found) == len(wanted) > 2
    for (keys, n), (all_keys, all_n) in zip(found, wanted, strict=True):
        assert keys.tolist() == all_keys[all_n > 1].tolist() and n.tolist() == all_n[all_n > 1].tolist()
    assert [len(x) for x in simhash.Repeats(4).flush()] == [0, 0]


def test_a_passage_that_the_sample_misses_is_known_as_common(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 4)
    passage = " ".join(f"licence{k}" for k in range(12))
    texts = [" ".join(f"t{k}w{j}" for j in range(30)) + (f" {passage}" if k % 10 == 0 else "") for k in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = simhash._signatures(docs, "doc_id", "text", simhash.NEAR_SHINGLE, simhash.SIMILARITY).select(F.explode("prefix").alias("key")).groupBy("key").count()
    assert rows.agg(F.max("count")).first()[0] < 5  # prefixes hold shingles of few texts


def share(a, b):
    a, b = (set(simhash.shingle_set(t.encode()).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_shortened_and_appended_copies_are_all_found(spark):
    rng = random.Random(3)
    vocabulary, odds = [f"w{k}" for k in range(20_000)], [1 / k for k in range(1, 20_001)]
    pairs = []
    while len(pairs) < 240:  # no exact copies among them
        base = rng.choices(vocabulary, odds, k=rng.choice([40, 150, 600]))
        part = int(len(base) * rng.uniform(0.1, 0.2))
        copy = (base[part:], base[:-part], base + rng.choices(vocabulary, odds, k=part))[len(pairs) % 3]
        a, b = " ".join(base), " ".join(copy)
        if share(a, b) >= 0.8:
            pairs.append((a, b))
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in range(len(pairs)) if found[2 * k] != found[2 * k + 1]] == []


def test_copies_whose_words_differ_much_are_found(spark):
    """The appended words are most of the distinct ones, so word signatures are far apart, but few of the shingles."""
    rng = random.Random(4)
    rows = []
    for k in range(6):
        base = [f"t{k}x{rng.randrange(12)}" for _ in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"appended{k}x{j}" for j in range(40)]))]
    assert all(share(a, b) >= 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i - i % 2 for i in range(12)}


def test_bloom_loses_no_key(spark):
    from pyspark.sql import functions as F

    from ledgerloom.llm.bloom import Bloom

    keys = spark.range(0, 4000, 2).select("id", F.md5(F.col("id").cast("string")).alias("digest")).union(spark.createDataFrame([(None, None)], "id long, digest string"))
    asked = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("digest")).union(spark.createDataFrame([(None, None)], "id long, digest string"))
    found = asked.where(Bloom(keys, ["id", "digest"]).may_hold("id", "digest")).collect()
    held = {r["id"] for r in found}
    assert held >= {None, *range(0, 4000, 2)} and len(held) < 2100
    full = asked.where(Bloom(keys, ["id", "digest"], most_bits=64).may_hold("id", "digest"))  # full, but never wrong
    assert {r["id"] for r in full.collect()} >= {None, *range(0, 4000, 2)}
    assert asked.where(Bloom(keys.where("false"), ["id", "digest"]).may_hold("id", "digest")).count() == 0


def test_bloom_counts_its_keys_once(spark, monkeypatch):
    from ledgerloom.llm.bloom import Bloom

    keys, asked = spark.range(5000), []
    count = type(keys).count
    monkeypatch.setattr(type(keys), "count", lambda self: asked.append(1) or count(self))
    assert Bloom(keys, ["id"]).bits == 1 << 17 and asked == [1]


def test_deduplicated_with_awkward_rows(spark):
    from ledgerloom.llm import simhash

    words = [f"word{k}" for k in range(200)]
    base, near, other = " ".join(words), " ".join([*words[:199], "changed"]), " ".join(reversed(words))
    rows = [(1, base), (2, near), (2, near), (3, base), (4, other), (4, other), (5, None), (6, ""), (None, base), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 7, "y") for i, t in rows], "doc_id long, text string, row string, id int, digest string")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(1, base), (4, other), (5, None), (None, base), (None, None)], key=str)
    assert simhash.deduplicated(docs.where("false")).count() == 0


def test_fingerprints_that_share_an_id_stay_apart(spark):
    one, other = " ".join(f"one{k}" for k in range(50)), " ".join(f"other{k}" for k in range(50))
    docs = spark.createDataFrame([(1, one), (5, one), (5, other), (7, other), (None, "no id here")], "doc_id long, text string")
    found = simhash.fingerprint_links(docs).collect()
    by_text = {one: simhash.fingerprint(one.encode()), other: simhash.fingerprint(other.encode())}
    got = sorted((r["doc_id"], r["fp"], r["component_id"]) for r in found if r["doc_id"] is not None)
    assert got == sorted([(1, by_text[one], 1), (5, by_text[one], 1), (5, by_text[other], 5), (7, by_text[other], 5)])
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
