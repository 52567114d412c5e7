"""MinHash near-duplicates: universal hash minima, banding, verification, components.

Texts are sets of distinct two-word shingles. Each of BANDS x ROWS universal hashes (multiply, add, shift) has
its minimum over a set; two sets agree on a minimum with the probability of their Jaccard similarity. Texts
that agree on all minima of a band meet in a bucket: at similarity 0.8 a pair meets nowhere once in
eight million times ((1 - 0.8^5)^40). Candidates are held against their signatures, a byte of each of the first minima,
then decided by the exact similarity of their full sets. Links are connected by alternating large-star and small-star.

Buckets of up to CAP texts are paired. In a larger one each text is paired with its PIVOTS first, the texts with
the most company in all of their buckets, and with its least; after components are known, texts that are still
apart from the bucket's first pivot meet all other groups of the bucket in blocks: a task holds two blocks
of at most BLOCK sets, counts what all of them share by one matrix product, and sends no more
links than connect them. So no link between groups is lost and no bucket is paired row by row.

Defined results: null text is empty; texts without a word link with nothing; equal texts link, whatever their
ids; null ids are never the least: their component is null if no id is reachable, and then they are kept;
texts that share an id are told apart; very long texts are taken whole; only id and text are read, so other
columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import slices
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import HOT_SHARE, SEED, _sets, shingles
from ledgerloom.storage import Shelf

SHINGLE, PERCENT, BANDS, ROWS = 2, 80, 40, 5
CAP, PIVOTS, BLOCK = 8, 2, 1024
#: Minima whose last byte is in the signature, and how many of them a pair must agree on: at 80 % similarity fewer come once in 10^8 times (binomial).
SIGNED, LEAST_AGREEING = 128, 74
#: Products of shingles and hashes at a time.
AT_ONCE = 1 << 18


def universal(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of `count` hashes."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 63, (2, count), np.int64).astype(np.uint64)
    return (drawn[0] << np.uint64(1)) | np.uint64(1), drawn[1]


def minima(hashes: np.ndarray, factors: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """The minimum of each hash over a set: the upper half of factor * x + addend, of the upper half x of what is hashed."""
    x = hashes.view(np.uint64) >> np.uint64(32)
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, AT_ONCE // len(factors))
    for low in range(0, len(x), step):
        own = factors[:, None] * x[None, low : low + step]
        own += addends[:, None]
        np.minimum(out, own.min(1), out=out)
    return out >> np.uint64(32)


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """A key of each band: its place and minima, mixed to 64 bits."""
    key = np.arange(1, len(least) // rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for column in least.reshape(-1, rows).T:
        key = (key ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int, count: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """(id, digest, n, bands, signed) of every row: the size of the set, the keys of bands and the last bytes of minima."""
    factors, addends = universal(count * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for whole in batches:
            for batch in slices(whole, "b"):
                n, keys, signed = [], [], []
                for t in batch.column("b").to_pylist():
                    own = set(shingles(t, size))
                    n.append(len(own))
                    least = minima(np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own)), factors, addends)
                    keys.append(bands(least, rows) if n[-1] else [])
                    signed.append(least[:SIGNED].astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(signed, pa.binary())], ["id", "digest", "n", "bands", "signed"])

    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.md5(text).alias("digest"), text.alias("b"))
    return plain.mapInArrow(run, "id long, digest string, n long, bands array<long>, signed binary")


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures (sa, sb) agree on `least` minima or more."""

    @F.pandas_udf("int")
    def agree(a, b):
        import pandas as pd

        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(len(c), -1) for c in (a, b))
        return pd.Series((x == y).sum(1).astype(np.int32))

    return pairs.where(agree("sa", "sb") >= least)


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have a Jaccard similarity of `percent` or more, in whole numbers."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def connecting(left: list[np.ndarray], right: list[np.ndarray], percent: int, width: int = 4096) -> list[tuple[int, int]]:
    """(left, right) places of sets at `percent` similarity or more: of these links as many as connect what they connect.

    Shared elements are counted by products of 0/1 matrices over at most `width` of the common elements at a time.
    """
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    flat = [np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right)]
    common = np.intersect1d(*flat)
    places = []
    for side, n in zip(flat, sizes, strict=True):
        at = np.searchsorted(common, side)
        hit = (at < len(common)) & (common[np.minimum(at, max(0, len(common) - 1))] == side) if len(common) else np.zeros(len(side), bool)
        places.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
    shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers below 2^24: exact
    for low in range(0, len(common), width):
        ones = []
        for (row, at), side in zip(places, (left, right), strict=True):
            m = np.zeros((len(side), min(width, len(common) - low)), np.float32)
            here = (at >= low) & (at < low + width)
            m[row[here], at[here] - low] = 1
            ones.append(m)
        shared += ones[0] @ ones[1].T
    near = 100 * shared.astype(np.int64)
    near = near >= percent * (sizes[0][:, None] + sizes[1][None, :] - near // 100)
    out, seen_left, seen_right = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in range(len(left)):  # a walk along the links, each place reached once
        if seen_left[start]:
            continue
        seen_left[start], front = True, [start]
        while front:
            i = front.pop()
            for j in np.flatnonzero(near[i] & ~seen_right).tolist():
                out.append((i, j))
                seen_right[j] = True
                onward = np.flatnonzero(near[:, j] & ~seen_left).tolist()
                out += [(o, j) for o in onward]
                seen_left[onward] = True
                front += onward
    return out


def _between(apart: DataFrame, others: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): links between rows (key, id, group, rows) of `apart` and of `others` of the same bucket, block by block, but for those within a group."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    many = F.ceil(F.col("rows") / block).cast("int")
    own = F.pmod(F.xxhash64("id", "key"), many).cast("int")
    every = F.explode(F.sequence(F.lit(0), many - 1))
    left, right = apart.withColumn("i", own).withColumn("j", every), others.withColumn("j", own).withColumn("i", every)
    # New names, as both sides come from the same tables.
    left, right = (df.join(sets, "id").select(*(F.col(c).alias(c) for c in ("key", "i", "j", "id", "group", "set"))) for df in (left, right))

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        ids = [np.asarray(t["id"]) for t in (x, y)]
        groups = [np.asarray(t["group"]) for t in (x, y)]
        views = [[np.asarray(s.values, np.int64) for s in t["set"]] for t in (x, y)]
        found = [(ids[0][i], ids[1][j]) for i, j in connecting(*views, percent) if groups[0][i] != groups[1][j]]
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], schema=schema)

    found = left.groupBy("key", "i", "j").cogroup(right.groupBy("key", "i", "j")).applyInArrow(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, count: int = BANDS, rows_a_band: int = ROWS, cap: int = CAP, pivots: int = PIVOTS, block: int = BLOCK,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    shelf = Shelf(docs.sparkSession)
    rows = shelf.cut(signatures(docs, size, count, rows_a_band, id_column, text_column), "signatures")
    first = F.min(F.struct("n", "bands", "signed"))
    texts = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), first.alias("x"))
    nodes = shelf.cut(texts.select("digest", "least", "copies", "x.*").withColumn("id", F.monotonically_increasing_id()), "texts")
    rows = shelf.cut(rows.select("id", "digest", "n"), "rows")
    shelf.drop("signatures")

    indexed = nodes.select("id", F.explode("bands").alias("key"))
    sizes = shelf.cut(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
    shared = shelf.cut(indexed.join(sizes, "key"), "shared")
    few = shared.where(F.col("rows") <= cap)
    # Texts of crowded buckets: one row each, with their buckets (no more than bands) and how much company they have in them.
    company = shared.where(F.col("rows") > cap).groupBy("id").agg(F.sum("rows").alias("company"), F.collect_list(F.struct("key", "rows")).alias("buckets"))
    crowd = shelf.cut(company, "crowd")
    crowded = crowd.select("id", "company", F.inline("buckets"))
    order = Window.partitionBy("key").orderBy(F.col("company").desc(), "id")
    heads = shelf.cut(crowded.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots), "heads")
    pair = lambda left, right, when: left.select("key", F.col("id").alias("p")).join(right.select("key", F.col("id").alias("q")), "key").where(when)
    met = pair(few, few, F.col("p") < F.col("q")).union(pair(crowded, heads, F.col("p") != F.col("q")))
    met = met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    facts = nodes.select("id", "n", "signed")
    told = met.join(facts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("signed").alias("sa")), "a").join(facts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("signed").alias("sb")), "b")
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    candidates = shelf.cut(_agreeing(told.where(alike), LEAST_AGREEING if percent >= PERCENT else 0).select("a", "b"), "candidates")

    def sets_of(asked: DataFrame, purpose: str) -> DataFrame:
        return shelf.cut(_sets(asked, nodes, docs, id_column, text_column, size).select("id", "set"), purpose)

    asked = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = shelf.cut(exact_links(candidates, sets_of(asked, "sets"), percent), "links")
    groups = shelf.cut(components(links), "groups")
    grouped = lambda df: df.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("component", "id")).drop("component")
    # Texts of crowded buckets in another group than the first pivot's.
    led = grouped(heads.where("place = 1").select("key", "id")).select("key", F.col("group").alias("led"))
    placed = grouped(crowd).select("id", "group", F.inline("buckets"))
    apart = shelf.cut(placed.join(led, "key").where(F.col("group") != F.col("led")).drop("led"), "apart")
    if apart.head(1):
        beside = placed.join(apart.select("key").distinct(), "key", "left_semi")
        more = _between(apart, beside, sets_of(beside.select("id").distinct(), "sets-apart"), percent, block)
        more = shelf.cut(more, "more")
        if more.head(1):
            groups = shelf.cut(components(links.union(more)), "all-groups")
    labelled = shelf.cut(grouped(nodes.select("id", "digest", "least", "copies")), "labelled")
    least = labelled.groupBy("group").agg(F.min("least").alias("component_id"))
    named = shelf.cut(labelled.join(least, "group").select("digest", "copies", "component_id"), "named")
    out = shelf.cut(_named(rows, named, id_column), "near-duplicates")
    shelf.paths.pop("near-duplicates")
    shelf.clear()
    return out


def _named(rows: DataFrame, named: DataFrame, id_column: str) -> DataFrame:
    """All rows with their components; texts with more than a thousandth of the rows are few and go to every task."""
    most = max(1, rows.count() // HOT_SHARE)
    hot = F.broadcast(named.where(F.col("copies") > most).select(F.col("digest").alias("of"), F.col("component_id").alias("found")))
    marked = rows.where("n > 0").join(hot, F.col("digest") == F.col("of"), "left")
    crowd = marked.where("of is not null").select("id", "n", F.col("found").alias("component_id"))
    rest = marked.where("of is null").select("id", "digest", "n").join(named.where(F.col("copies") <= most), "digest").select("id", "n", "component_id")
    alone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    every = crowd.union(rest).union(alone)
    return every.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
