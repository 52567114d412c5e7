"""SimHash near-duplicates found by generalised pigeonhole search.

`fingerprint_links`: 64-bit fingerprints of word shingles, linked at a small Hamming distance. Equal
fingerprints are one node. Nodes are indexed by the parts that gph.plan chooses, probed within the
thresholds and verified on all bits. A bucket of more than CAP nodes is not paired: its members are
keyed by their fingerprint and by each of its one-bit changes instead. Two nodes within two bits share
such a key, nodes that share one are within two bits, and no key has more than 65 of them, so linking
each to the least node of its key loses no link and makes no pairs.

`near_texts`: texts whose five-word shingle sets have a Jaccard similarity of 0.8 or more. Equal texts
are one node, known by a number of its own and not by an id, as different texts may share one. Candidates
come from their fingerprints first, by the same search as above (`fingerprint_pairs`), and an exact check of
the sets follows. No Hamming radius holds all pairs of that similarity, so what this leaves in different
groups is then searched by a prefix filter, which loses no pair: shingles are put into one order
for all sets, and two similar sets share a shingle among the first n - ceil(0.8 n) + 1 of each. Any order
is exact; shingles that are common in a bounded sample, or repeat within blocks of all texts, come last, so
that prefixes hold rare ones: a sample alone tells ever fewer of them apart as the table grows. In
buckets of more than NEAR_CAP nodes each node is compared with PIVOTS of them first, those whose
buckets are largest over all of their prefix: what many texts are edited from shares more buckets than any edit of
it. Then every node that is not yet connected with the bucket's first pivot is compared with all nodes of
the bucket in other groups, so no link between groups is lost. Pairs that are too far apart are left out
before their sets are compared, by bounds that lose no link: where in the order the shared shingle stands,
how many shingles the prefixes share, and sketches, the parities of how many of a set's shingles fall on
each of 512 places, which never differ in more places than the sets in shingles.

Defined results: null text is empty; texts without a word have fingerprint zero and are linked like any
other; repeated rows are equal texts; null ids get a fingerprint, a null component_id unless their
fingerprint has an id, and are never dropped; texts that share an id are told apart; of a group the row of
the least id stays, of several texts of that id the one with the least digest; very long texts are taken
whole; columns of the input keep their values whatever their names; an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import gph
from ledgerloom.llm.bloom import Bloom
from ledgerloom.llm.bpe import slices
from ledgerloom.llm.components import components
from ledgerloom.storage import Shelf, cut

SHINGLE, RADIUS, SEED, CAP = 3, 2, 42, 64
NEAR_SHINGLE, SIMILARITY, NEAR_CAP, PIVOTS = 5, 0.8, 8, 2
#: Texts that are sampled for the order of shingles, and places of the table that tells how common they are (4 MB); half of them are used at most.
SAMPLE, PLACES = 16_384, 1 << 22
#: Shingles among which a task counts repeats at a time (32 MB).
BLOCK = 1 << 22
HOT_SHARE = 1000
#: Longs of a sketch of parities, and of the wider one of sets with more shingles than WIDE.
SKETCH, WIDE_SKETCH, WIDE = 8, 256, 1024


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of `size` words, repeats included; of fewer words the whole sequence. Only A-Z is lower-cased."""
    words = text.lower().split()  # bytes: A-Z, and white space of ASCII
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    return [joined[starts[i] : ends[i + size - 1]] for i in range(len(words) - size + 1)]


def fingerprint(text: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for s in shingles(text, size)], "<u8")
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for low in range(0, len(h), 65_536):
        ones += np.unpackbits(h[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp) with fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "b"):
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([fingerprint(t or b"", size) for t in batch.column("b").to_pylist()], pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("b")).mapInArrow(run, "id long, fp long")


def _sizes(indexed: DataFrame) -> DataFrame:
    """(part, key, n) of buckets with n rows, of more than one."""
    return cut(indexed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")


def _buckets(indexed: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(part, key) of buckets with 2 to cap rows, and of larger ones."""
    sizes = _sizes(indexed)
    return sizes.where(F.col("n") <= cap).drop("n"), sizes.where(F.col("n") > cap)


def _star_links(nodes: DataFrame) -> DataFrame:
    """(a, b) that connect nodes (id, fp) within two bits of each other."""
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(gph.signed(1 << b)) for b in range(64)))
    keyed = nodes.select("id", F.explode(flips).alias("key"))
    least = F.min("id").over(Window.partitionBy("key"))  # 65 rows at most
    return keyed.select(F.col("id").alias("a"), least.alias("b")).where("a <> b").distinct()


def links(nodes: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(a, b): links that connect all nodes (id, fp; distinct fps) within `radius` bits, up to 2."""
    if not 0 <= radius <= 2:
        raise ValueError("radius is 0 to 2")
    if radius == 0:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    parts = gph.plan(*gph.bit_counts(nodes, ["fp"]), radius, range(1, radius + 3))
    indexed = gph.index(nodes, ["fp"], parts)
    if all(p.threshold <= 0 for p in parts):
        small, large = _buckets(indexed, cap)
        own = cut(indexed.join(small, ["part", "key"]), "small-buckets")
        probing = own
    else:
        _, large = _buckets(indexed, cap)
        own = indexed.join(large, ["part", "key"], "left_anti")
        probing = gph.probes(nodes, ["fp"], parts)
    left, right = probing.select("part", "key", F.col("id").alias("a"), F.col("fp").alias("fa")), own.select("part", "key", F.col("id").alias("b"), F.col("fp").alias("fb"))
    near = (left["part"] == right["part"]) & (left["key"] == right["key"]) & (F.col("a") != F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius)
    found = left.join(right, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crowded = indexed.join(large.drop("n"), ["part", "key"]).select("id", "fp").distinct()
    stars = _star_links(crowded)
    if radius == 1:  # sharing a key is within two bits, so each is held against the node that it shares it with
        fps = nodes.select(F.col("id").alias("n"), "fp")
        flips = F.array(*(F.col("fp").bitwiseXOR(gph.signed(1 << b)) for b in range(64)))
        stars = crowded.select(F.col("id").alias("a"), F.explode(flips).alias("fp")).join(fps, "fp").select("a", F.col("n").alias("b"))
    return found.union(stars)


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: pairs that connect all nodes (id, fp; fps may repeat) with equal fingerprints or some within `radius` bits."""
    heads = cut(nodes.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "heads")
    equal = nodes.join(heads.where("n > 1").select("fp", F.col("id").alias("head")), "fp").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    near = links(heads.select("id", "fp"), radius).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(near).distinct()


def fingerprint_links(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fp, component_id, copies): the least id that links reach, and how many rows share the fingerprint."""
    rows = cut(fingerprints(docs, size, id_column, text_column), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")
    # Nodes are known by their fingerprints, as different ones may share an id.
    found = components(links(nodes.where("id is not null").select(F.col("fp").alias("id"), "fp"), radius))
    grouped = cut(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")), "grouped")
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    labelled = cut(grouped.join(least, "root").select("fp", "copies", "component_id"), "labels")
    # Fewer than HOT_SHARE fingerprints can have over 1 / HOT_SHARE of the rows; these go to every task.
    most = max(1, rows.count() // HOT_SHARE)
    hot = F.broadcast(labelled.where(F.col("copies") > most).select(F.col("fp").alias("hot_fp"), F.col("copies").alias("hot_copies"), F.col("component_id").alias("hot_id")))
    marked = rows.join(hot, F.col("fp") == F.col("hot_fp"), "left")
    crowd = marked.where("hot_fp is not null").select("id", "fp", F.col("hot_id").alias("component_id"), F.col("hot_copies").alias("copies"))
    rest = marked.where("hot_fp is null").select("id", "fp").join(labelled, "fp").select("id", "fp", "component_id", "copies")
    return crowd.union(rest).withColumnRenamed("id", id_column)


def shingle_set(text: bytes, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles."""
    import xxhash

    return np.array(sorted({xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)}), np.uint64).view(np.int64)


def parities(shingle_hashes: np.ndarray, longs: int = SKETCH) -> np.ndarray:
    """Signed longs, a power of two: for each place, whether an odd number of the hashes falls on it."""
    counts = np.bincount((shingle_hashes & (64 * longs - 1)).astype(np.int64), minlength=64 * longs)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8").astype(np.int64)


def prefix_size(n: int, similarity: float = SIMILARITY) -> int:
    """How many of n shingles, in the common order, hold one of each set of this similarity; texts without a word have a key of their own."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def prefix(shingle_hashes: np.ndarray, levels: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order of all sets: by the level at their place of the table, then by hash."""
    if not len(shingle_hashes):
        return np.zeros(1, np.int64)
    level = levels[shingle_hashes & (len(levels) - 1)]
    return shingle_hashes[np.lexsort((shingle_hashes, level))[: prefix_size(len(shingle_hashes), similarity)]]


class Repeats:
    """Counts hashes that come more than once among up to `most` at a time; equal texts count once in a block."""

    def __init__(self, most: int):
        self.block, self.used, self.seen = np.empty(most, np.int64), 0, set()

    def add(self, digest: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if digest in self.seen:
            return
        while len(own):
            part, own = np.split(own, [len(self.block) - self.used])
            self.block[self.used : self.used + len(part)] = part
            self.used += len(part)
            if self.used == len(self.block):
                yield self.flush()
        self.seen.add(digest)

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        """The hashes that repeat in the block, and how often they are there."""
        full = self.block[: self.used]
        full.sort()
        keys, n = np.unique(full[1:][full[1:] == full[:-1]], return_counts=True)
        self.used, self.seen = 0, set()
        return keys, n + 1


def _levels(docs: DataFrame, text_column: str, size: int) -> np.ndarray:
    """How common shingles seem to be, eighths of powers of two by the last bits of their hashes; zero for rare ones.

    Counted among a sample of different texts and, where that is not all, within blocks of all texts; the larger holds,
    of shingles at one place that of the most common. A rare one that meets a common one there is only taken later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "b"):
                own = [shingle_set(t or b"", size) for t in batch.column("b").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], ["key"])

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def told(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.float64))], ["key", "n"])

        repeats = Repeats(BLOCK)
        for whole in batches:
            for batch in slices(whole, "b"):
                for t in batch.column("b").to_pylist():
                    for found in repeats.add(xxhash.xxh64_intdigest(t), shingle_set(t, size)):
                        yield told(found)
        yield told(repeats.flush())

    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    share = min(1.0, SAMPLE / max(1, docs.count()))
    drawn = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    texts = docs.select(text.alias("b")).where(drawn).dropDuplicates(["b"])
    counts = texts.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("key", (F.col("n") / share).alias("n"))
    if share < 1:
        within = docs.select(text.alias("b")).mapInArrow(repeat, "key long, n double").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2")
        counts = counts.union(within).groupBy("key").agg(F.max("n").alias("n"))
    places = counts.groupBy(F.col("key").bitwiseAND(PLACES - 1).cast("int").alias("place")).agg(F.max("n").alias("n"))
    found = places.orderBy(F.col("n").desc(), "place").limit(PLACES // 2).toArrow()
    levels = np.zeros(PLACES, np.uint8)
    levels[np.asarray(found["place"])] = np.clip(8 * np.log2(np.asarray(found["n"])), 1, 255).astype(np.uint8)
    return levels


def _signatures(docs: DataFrame, id_column: str, text_column: str, size: int, similarity: float) -> DataFrame:
    """(id, digest, n, fp, s0, ..., prefix): the number of distinct shingles, the fingerprint, the sketch and the first shingles in the order."""
    levels = _levels(docs, text_column, size)
    names = [f"s{k}" for k in range(SKETCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "b"):
                texts = [t or b"" for t in batch.column("b").to_pylist()]
                own = [shingle_set(t, size) for t in texts]
                fps = pa.array([fingerprint(t) for t in texts], pa.int64())
                found = np.array([parities(x) for x in own], np.int64).reshape(-1, SKETCH)
                first = [prefix(x, levels, similarity) for x in own]
                columns = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(SKETCH)]
                ends = pa.array(np.cumsum([0, *map(len, first)], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *first])))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array([len(x) for x in own], pa.int32()), fps, *columns, lists], ["id", "digest", "n", "fp", *names, "prefix"])

    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    plain = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.md5(text).alias("digest"), text.alias("b"))
    return plain.mapInArrow(run, ", ".join(["id long, digest string, n int, fp long", *(f"{n} long" for n in names), "prefix array<long>"]))


def _sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame, id_column: str, text_column: str, size: int) -> DataFrame:
    """(id, set, wide): the shingles of the nodes asked for, and the wide sketch of large sets, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "b"):
                sets = [shingle_set(t or b"", size) for t in batch.column("b").to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
                wide = pa.array([parities(x, WIDE_SKETCH) if len(x) > WIDE else None for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))), wide], ["id", "set", "wide"])

    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    wanted = cut(nodes.join(asked, "id", "left_semi").select(F.col("least").alias("row_id"), "digest", "id"), "wanted")
    texts = docs.select(F.col(id_column).cast("long").alias("row_id"), F.md5(text).alias("digest"), text.alias("b"))
    texts = texts.where(Bloom(wanted, ["row_id", "digest"]).may_hold("row_id", "digest")).dropDuplicates(["row_id", "digest"])
    return texts.join(wanted, ["row_id", "digest"]).select("id", "b").mapInArrow(run, "id long, set array<long>, wide array<long>")


def _jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, similarity): the Jaccard similarity of the shingle sets of pairs (a, b)."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return both.select("a", "b", F.when(union == 0, 1.0).otherwise(shared / union).alias("similarity"))


def near_texts(
    docs: DataFrame, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY, cap: int = NEAR_CAP, pivots: int = PIVOTS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, digest, component_id, stays) for every row with an id: the MD5 of the text, the least id of its group, and whether it is the row that stands for it."""
    shelf = Shelf(docs.sparkSession)
    sketch = [f"s{k}" for k in range(SKETCH)]
    rows = shelf.cut(_signatures(docs, id_column, text_column, size, similarity), "signatures")
    # Most texts are alone; only those that a filter takes for repeated ones are exchanged with their prefixes.
    again = shelf.cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest"), "repeated")
    repeated = Bloom(again, ["digest"]).may_hold("digest")
    once = rows.where(~repeated).select("digest", F.col("id").alias("least"), "n", "fp", *sketch, "prefix")
    texts = rows.where(repeated).groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct("n", "fp", *sketch, "prefix")).alias("x"))
    nodes = shelf.cut(once.union(texts.select("digest", "least", "x.*")).withColumn("id", F.monotonically_increasing_id()), "texts")
    rows = shelf.cut(rows.select("id", "digest"), "rows")
    shelf.drop("signatures")
    needed = similarity * (F.col("a_n") + F.col("b_n")) - 1e-6  # times 1 + similarity: how many shingles such sets share
    # What sets can share if this is the first that they do.
    ahead = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) * (1 + similarity) >= needed
    apart_by = gph.distance([F.col(f"a_{n}") for n in sketch], [F.col(f"b_{n}") for n in sketch])
    # Sets of this similarity differ in no more shingles than that.
    possible = apart_by * (1 + similarity) <= (F.col("a_n") + F.col("b_n")) * (1 - similarity) + 1e-6
    # Nor are their sizes further apart.
    alike = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - 1e-6

    def met(left: DataFrame, right: DataFrame, columns: list[str], when) -> DataFrame:
        x, y = (df.select("key", *(F.col(n).alias(f"{k}_{n}") for n in ("id", "n", "at", "group", *columns))) for df, k in ((left, "a"), (right, "b")))
        return x.join(y, (x["key"] == y["key"]) & (F.col("a_group") != F.col("b_group")) & when & alike)

    def pairs(left: DataFrame, right: DataFrame, columns: list[str], when) -> DataFrame:
        found = met(left, right, columns, when & ahead).select(F.when(F.col("a_id") < F.col("b_id"), F.struct(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_n", "b_n")).otherwise(F.struct(F.col("b_id").alias("a"), F.col("a_id").alias("b"), F.col("b_n").alias("a_n"), F.col("a_n").alias("b_n"))).alias("p"))
        return found.select("p.*").distinct()

    def told(candidates: DataFrame, facts: DataFrame) -> DataFrame:
        """(a, b, ...) with the facts (id, ...) of both."""
        for k in ("a", "b"):
            candidates = candidates.join(facts.select(*(F.col(c).alias(k if c == "id" else f"{k}_{c}") for c in facts.columns)), k)
        return candidates

    def linked(candidates: DataFrame) -> DataFrame:
        asked = candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = shelf.cut(_sets(asked, nodes, docs, id_column, text_column, size), "shingle-sets")
        # Large sets are held apart by their wide sketches first, which are a small part of them.
        for k in ("a", "b"):
            candidates = candidates.join(sets.where("wide is not null").select(F.col("id").alias(k), F.col("wide").alias(f"{k}_wide"), F.size("set").alias(f"{k}_n")), k, "left")
        differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        close = differ * (1 + similarity) <= (F.col("a_n") + F.col("b_n")) * (1 - similarity) + 1e-6
        candidates = shelf.cut(candidates.where(F.coalesce(close, F.lit(True))).select("a", "b"), "to-verify")
        found = shelf.cut(_jaccard(candidates, sets).where(F.col("similarity") >= similarity).select("a", "b"), "links")
        shelf.drop("shingle-sets", "to-verify")
        return found

    # What the search by fingerprints finds and the exact check confirms; all that follows looks only between these groups.
    # Written between the steps, here and below: while a query runs its whole plan is planned anew after every exchange, in the driver.
    alike_prints = shelf.cut(fingerprint_pairs(nodes.select("id", "fp")), "alike-prints")
    met_by_print = told(alike_prints, nodes.select("id", "n", *sketch)).where(alike & possible).select("a", "b")
    met_by_print = shelf.cut(met_by_print, "fingerprint-pairs")
    shelf.drop("alike-prints")
    by_print = linked(met_by_print)
    groups = shelf.cut(components(by_print), "fingerprint-groups").select(F.col("node").alias("id"), F.col("component").alias("g"))
    entry = ["id", "n", "prefix"]
    grouped = Bloom(groups, ["id"]).may_hold("id")  # only nodes that may be in a group are exchanged with their prefixes
    alone = nodes.where(~grouped).select(*entry, F.col("id").alias("group"))
    nodes_in = alone.union(nodes.where(grouped).join(groups, "id", "left").select(*entry, F.coalesce("g", "id").alias("group")))
    indexed = nodes_in.select("id", "n", "group", F.posexplode("prefix").alias("at", "key"))
    sizes = shelf.cut(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "buckets")
    shared = shelf.cut(indexed.join(sizes, "key"), "shared-buckets")

    few, crowded = shared.where(F.col("rows") <= cap), shared.where(F.col("rows") > cap)
    crowd = shelf.cut(crowded.groupBy("id").agg(F.sum("rows").alias("popular"), F.count(F.lit(1)).alias("places")), "crowds")
    many = crowded.join(crowd.drop("places"), "id")
    order = Window.partitionBy("key").orderBy(F.col("popular").desc(), "id")
    first = shelf.cut(many.withColumn("place", F.row_number().over(order)).where(F.col("place") <= pivots), "pivots")
    # Beyond their prefixes two sets share less than the larger's share of the similarity, in crowded buckets no more than either is in.
    together = met(few, few, [], F.col("a_id") < F.col("b_id")).groupBy(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    loose = together.agg(F.count(F.lit(1)).alias("common"), F.max("a_n").alias("a_n"), F.max("b_n").alias("b_n"), F.max(ahead).alias("ahead")).where("ahead")
    rest = F.ceil(F.greatest("a_n", "b_n") * similarity - 1e-9) - 1
    shares = (F.col("common") + F.least("a_places", "b_places") + rest) * (1 + similarity) >= needed
    loose = shelf.cut(loose.select("a", "b", "a_n", "b_n", "common"), "loose")
    held = shelf.cut(pairs(crowded, first, [], F.lit(True)), "held")
    facts = shelf.cut(nodes.join(crowd.select("id", "places"), "id", "left").select("id", F.coalesce("places", F.lit(0)).alias("places"), *sketch), "facts")
    either = loose.unionByName(held.withColumn("common", F.lit(None).cast("long")))  # pairs with a pivot are not counted
    found = told(either, facts).where(F.coalesce(shares, F.lit(True)) & possible).select("a", "b")
    found = shelf.cut(found.distinct().join(met_by_print, ["a", "b"], "left_anti"), "candidates")
    shelf.drop("loose", "held", "facts")
    joined = by_print.union(linked(found))
    groups = shelf.cut(components(joined), "groups")
    # What the pivots left apart: nodes of large buckets in another group than the first pivot's.
    group = groups.select(F.col("node").alias("id"), F.col("component").alias("g"))
    heads = first.where("place = 1").select("key", "id").join(group, "id", "left").select("key", F.coalesce("g", "id").alias("head"))
    placed = crowded.select("key", "id", "n", "at").join(group, "id", "left").withColumn("group", F.coalesce("g", "id")).drop("g")
    apart = shelf.cut(placed.join(heads, "key").where(F.col("group") != F.col("head")).drop("head"), "apart")
    # Only nodes of these buckets need their sketches here.
    with_sketch = lambda df: df.join(nodes.select("id", *sketch), "id")
    others = with_sketch(placed.join(apart.select("key").distinct(), "key", "left_semi"))
    more = pairs(with_sketch(apart), others, sketch, possible).select("a", "b").distinct()
    more = shelf.cut(more.join(found.union(met_by_print), ["a", "b"], "left_anti"), "more")
    if more.head(1):
        groups = shelf.cut(components(joined.union(linked(more))), "all-groups")
    labelled = nodes.select("id", "digest", "least").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = shelf.cut(labelled, "labelled")
    stands = labelled.groupBy("component").agg(F.min(F.struct("least", "digest")).alias("head"))
    named = labelled.join(stands, "component").select("digest", F.col("head.least").alias("component_id"), (F.col("digest") == F.col("head.digest")).alias("heads"))
    out = shelf.cut(rows.join(named, "digest").select("id", "digest", "component_id", (F.col("heads") & (F.col("id") == F.col("component_id"))).alias("stays")), "near-texts")
    shelf.paths.pop("near-texts")
    shelf.clear()
    return out.withColumnRenamed("id", id_column)


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The documents without those that another of their group stands for; rows that are repeated stay once."""
    found = near_texts(docs, id_column=id_column, text_column=text_column, **how)
    keys = found.select(F.col(id_column).alias("id"), "digest", (~F.col("stays")).alias("gone"))
    keys = keys.groupBy("id", "digest").agg(F.max("gone").alias("gone"), F.count(F.lit(1)).alias("n"))
    touched = cut(keys.where("gone or n > 1"), "touched")
    digest = F.md5(F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).cast("long").alias("id"), digest.alias("digest"))
    touch = Bloom(touched, ["id", "digest"]).may_hold("id", "digest")
    near = rows.where(touch).join(touched.where("gone"), ["id", "digest"], "left_anti")
    kept = rows.where(~touch)
    again = touched.where("not gone").select("id", "digest")
    if again.head(1):
        kept = kept.union(near.join(again, ["id", "digest"], "left_semi").select("row", "id", "digest").dropDuplicates(["id", "digest"]))
        near = near.join(again, ["id", "digest"], "left_anti")
    return kept.union(near.select("row", "id", "digest")).select("row.*")
