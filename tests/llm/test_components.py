"""Connected components against a plain search, and what the search for near copies asks of the driver."""

from __future__ import annotations

import random

import pytest

from ledgerloom.llm import components as C
from ledgerloom.llm import simhash
from ledgerloom.storage import Shelf

KEPT = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def many_partitions(spark):
    """As on a session that deals every exchange out over many tasks."""
    before = {k: spark.conf.get(k) for k in KEPT}
    for k, v in zip(KEPT, ("16", "false"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _plain(edges):
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            least[high] = low
    return {x: find(x) for x in list(least)}


def _planned(monkeypatch):
    """(purpose, physical plan, partitions if it has no exchange) of every table that is written from now on."""
    seen, cut = [], Shelf.cut

    def noted(self, df, purpose):
        seen.append((purpose, df._jdf.queryExecution().executedPlan().toString()))
        return cut(self, df, purpose)

    monkeypatch.setattr(Shelf, "cut", noted)
    return seen


@pytest.mark.parametrize("together", [C.TOGETHER, 0])  # in one partition, and dealt out
def test_components_against_a_plain_search(spark, monkeypatch, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    pick = random.Random(5)
    chain = [(k, k + 1) for k in range(1000, 1040)]
    star = [(2000, 2000 + k) for k in range(1, 200)]
    loose = [(pick.randrange(300), pick.randrange(300)) for _ in range(160)]
    edges = [*chain, *star, *loose, *loose[:9], (7, 7), (None, 3), (4, None), (-5, 2100)]
    found = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == _plain(edges) and len(found) == len(_plain(edges))
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_need_no_exchange_in_their_rounds(spark, monkeypatch, many_partitions):
    seen = _planned(monkeypatch)
    found = C.components(spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long"))
    rounds = [plan for purpose, plan in seen if purpose.startswith("round-") and purpose != "round-0"]
    assert len(rounds) > 1 and not any("Exchange" in plan for plan in rounds)
    assert found.rdd.getNumPartitions() <= 2 and {r["component"] for r in found.collect()} == {0}


def test_no_query_of_the_search_for_near_copies_plans_many_exchanges(spark, monkeypatch, many_partitions):
    """Spark plans all of a running query anew after each of its exchanges, in the driver."""
    seen = _planned(monkeypatch)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.near_texts(docs).count() == len(texts)
    counts = {purpose: plan.count("Exchange") for purpose, plan in seen}
    print(counts)
    assert max(counts.values()) <= 12, counts
