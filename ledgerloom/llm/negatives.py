"""Hard negatives by a block matrix multiply over a grid of rows and dimension chunks (SUMMA-style).

Rows become integer weights floor(scale * x) and fall into blocks, anchors into blocks of their own; the
components fall into chunks. A cell of the grid is (anchor block, row block, chunk): a task multiplies the two
panels that meet there, which gives a partial tile of int64 scores. The partial tiles of a pair of blocks are
shuffled together and added. The sums are reduced twice, over one exchange: to each anchor's best rows of its
own label, which merge to its positives; then, beside these positives, to the best rows of other labels
within each positive's window, which merge to its negatives.

Between tasks, integers travel as the bytes that the largest of a tile needs, one plane a byte, small negative
numbers as small ones (`packed`): what the shuffle's compression then leaves of a score is little more
than the bits it has.

Defined results: rows whose id, label or vector is null, or holds null or a non-finite component, take no part;
vectors of different lengths are padded with zeros; a row with the anchor's own id is never its positive; a
repeated anchor row is answered once, different rows under one id are anchors of their own; repeated rows are
candidates each, and as positives have negatives each; ties go to the smaller id; an empty table gives no rows. Scores
are exact: tiles that might leave 64 bits are computed with Python's integers, and a score that no long can hold
is returned as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.topk import SCALE, _matrix

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows and anchors of a block, components of a chunk.
GROUP, BATCH, CHUNK = 2048, 256, 32
#: Arrays of up to this size are multiplied at a time.
SAFE = 2**55


def packed(a: np.ndarray) -> bytes:
    """An integer array as bytes: how many planes, then the planes; Python integers as their digits."""
    if a.dtype == object:
        return b"\0" + ",".join(map(str, a.reshape(-1).tolist())).encode()
    flat = np.ascontiguousarray(a, np.int64).reshape(-1)
    folded = ((flat << 1) ^ (flat >> 63)).view(np.uint64)
    planes = max(1, -(-int(folded.max(initial=0)).bit_length() // 8))
    return bytes([planes]) + folded.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(b: bytes, *shape: int) -> np.ndarray:
    planes = b[0]
    if not planes:
        return np.array([int(x) for x in b[1:].split(b",") if x], object).reshape(shape)
    own = np.frombuffer(b, np.uint8, offset=1).reshape(planes, -1)
    wide = np.zeros((own.shape[1], 8), np.uint8)
    wide[:, :planes] = own.T
    folded = wide.view("<u8").reshape(-1)
    return ((folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)).reshape(shape)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x b', exactly, as int64 or as Python integers."""
    most = [int(abs(m).max(initial=0)) for m in (a, b)]
    bound = most[0] * most[1] * a.shape[1]
    kind = np.float64 if bound < 2**52 else np.int64 if bound < SAFE else object
    found = a.astype(kind) @ b.astype(kind).T
    return found if kind is object else found.astype(np.int64)


def best_positives(scores: np.ndarray, same: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(anchor, row) of each anchor's k best rows where `same` holds; rows are in order of id."""
    found = []
    for i, own in enumerate(scores):
        at = np.flatnonzero(same[i])
        found += [(i, int(p)) for p in at[np.argsort(-own[at], kind="stable")[:k]]]
    return found


def best_negatives(own: np.ndarray, other: np.ndarray, positives: list[int], k: int, low: int, high: int) -> list[list[int]]:
    """For each positive score the k best rows with low % <= score <= high % of it, where `other` holds."""
    if not len(positives):
        return []
    at = np.flatnonzero(other & (own * 100 >= low * min(positives)) & (own * 100 <= high * max(positives)))
    at = at[np.argsort(-own[at], kind="stable")]
    falling = -own[at] * 100  # ascends
    out = []
    for score in positives:
        first = int(np.searchsorted(falling, -high * score, "left"))
        last = int(np.searchsorted(falling, -low * score, "right"))
        out.append([int(p) for p in at[first : min(last, first + k)]])
    return out


def _blocks(rows: DataFrame, wide: int, chunk: int, scale: int) -> DataFrame:
    """(block, k, rows, w, ids, labels): a row for each chunk of a block; ids and labels with the first."""
    schema = pa.schema([("block", pa.int32()), ("k", pa.int32()), ("rows", pa.int32()), ("w", pa.binary()), ("ids", pa.binary()), ("labels", pa.list_(pa.string()))])

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("label", "ascending")])
        own = _matrix(t["v"], scale)
        w = np.zeros((len(own), wide), own.dtype)
        w[:, : own.shape[1]] = own
        out = []
        for k, low in enumerate(range(0, wide, chunk)):
            head = (packed(np.asarray(t["id"])), t["label"].to_pylist()) if k == 0 else (None, None)
            out.append((t["block"][0].as_py(), k, len(w), packed(w[:, low : low + chunk]), *head))
        return pa.Table.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(schema)], schema=schema)

    return rows.groupBy("block").applyInArrow(run, "block int, k int, rows int, w binary, ids binary, labels array<string>")


class Tile:
    """The added tile of a pair of blocks; rows and anchors in order of id."""

    def __init__(self, t: pa.Table):
        head = next(r for r in t.to_pylist() if r["a_ids"] is not None)
        shape = head["a_rows"], head["b_rows"]
        parts = [unpacked(b, *shape) for b in t["tile"].to_pylist()]
        safe = sum(int(abs(p).max(initial=0)) for p in parts) < SAFE
        self.scores = sum(p if safe else p.astype(object) for p in parts)
        self.a_ids, self.b_ids = unpacked(head["a_ids"], shape[0]), unpacked(head["b_ids"], shape[1])
        self.anchors = shape[0]
        codes: dict[str, int] = {}
        a, b = (np.array([codes.setdefault(x, len(codes)) for x in head[n]], np.int64) for n in ("a_labels", "b_labels"))
        self.same = a[:, None] == b[None, :]


def _long(x: int) -> int | None:
    return int(x) if -(2**63) <= x < 2**63 else None


def mine(
    rows: DataFrame, anchors: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, group: int = GROUP, batch: int = BATCH, chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds."""
    v = F.col(vector_column)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull() & v.isNotNull() & finite)
    own = own.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"), v.alias("v"), F.coalesce(anchors, F.lit(False)).alias("asked"))
    facts = own.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(F.size("v"))).first()
    wide = max(1, facts[2] or 0)
    groups, batches = max(1, -(-facts[0] // group)), max(1, -(-facts[1] // batch))
    place = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    panel = lambda df, side: [F.col("rows").alias(f"{side}_rows"), F.col("w").alias(f"{side}_w"), F.col("ids").alias(f"{side}_ids"), F.col("labels").alias(f"{side}_labels")]
    # A row's place in its file says its block, so that repeated rows spread over all of them.
    asked = _blocks(own.where("asked").select("id", "label", "v").distinct().withColumn("block", place(batches, "id", "label", "v")), wide, chunk, scale)
    held = _blocks(own.select("id", "label", "v").withColumn("block", place(groups, F.monotonically_increasing_id())), wide, chunk, scale)
    left = asked.select(F.col("block").alias("i"), every(groups, "j"), "k", *panel(asked, "a"))
    right = held.select(F.col("block").alias("j"), every(batches, "i"), "k", *panel(held, "b"))
    cells = left.join(right, ["i", "j", "k"])
    names = ["i", "j", "a_rows", "b_rows", "a_ids", "b_ids", "a_labels", "b_labels"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for n in range(whole.num_rows):
                one = whole.slice(n, 1)
                a, b = (unpacked(one.column(f"{s}_w")[0].as_py(), one.column(f"{s}_rows")[0].as_py(), -1) for s in "ab")
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), pa.array([packed(product(a, b))], pa.binary())], [*names, "tile"])

    partial = cells.mapInArrow(multiply, "i int, j int, a_rows int, b_rows int, a_ids binary, b_ids binary, a_labels array<string>, b_labels array<string>, tile binary")

    def select_positives(t: pa.Table) -> pa.Table:
        tile = Tile(t)
        found = best_positives(tile.scores, tile.same & (tile.a_ids[:, None] != tile.b_ids[None, :]), positives)
        columns = [[t["i"][0].as_py()] * len(found), [f[0] for f in found], tile.a_ids[[f[0] for f in found]].tolist(), tile.b_ids[[f[1] for f in found]].tolist(), [str(tile.scores[f]) for f in found]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["i", "at", "anchor_id", "positive_id", "score"])

    by_tile = partial.groupBy("i", "j").applyInArrow(select_positives, "i int, at int, anchor_id long, positive_id long, score string")
    wanted = _first(by_tile, ["i", "at"], positives, "positive_id", "place")
    # An anchor block has batch x positives of them at most; they go to each of its tiles.
    beside = wanted.groupBy("i").agg(F.collect_list(F.struct("at", "place", "anchor_id", "positive_id", "score")).alias("wanted")).select("i", every(groups, "j"), "wanted")

    def select_negatives(t: pa.Table, w: pa.Table) -> pa.Table:
        kinds = {"i": pa.int32(), "at": pa.int32(), "place": pa.int32(), "anchor_id": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.string(), "negative_id": pa.int64(), "score": pa.string()}
        out: list[list] = [[] for _ in kinds]
        if t.num_rows and w.num_rows:
            tile, i = Tile(t), t["i"][0].as_py()
            by_anchor: dict[int, list[dict]] = {}
            for p in w["wanted"][0].as_py():
                by_anchor.setdefault(p["at"], []).append(p)
            for at, own_positives in by_anchor.items():
                scores = tile.scores[at]
                for p, found in zip(own_positives, best_negatives(scores, ~tile.same[at], [int(p["score"]) for p in own_positives], negatives, low, high), strict=True):
                    for r in found:
                        for column, value in zip(out, (i, at, p["place"], p["anchor_id"], p["positive_id"], p["score"], int(tile.b_ids[r]), str(scores[r])), strict=True):
                            column.append(value)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values(), strict=True)], names=list(kinds))

    negative = "i int, at int, place int, anchor_id long, positive_id long, positive_score string, negative_id long, score string"
    found = partial.groupBy("i", "j").cogroup(beside.groupBy("i", "j")).applyInArrow(select_negatives, negative)
    ranked = _first(found, ["i", "at", "place"], negatives, "negative_id", "rank")
    number = lambda c: F.expr(f"try_cast({c} as long)")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", number("positive_score").alias("positive_score"), number("score").alias("negative_score"))


def _first(df: DataFrame, by: list[str], most: int, tie: str, name: str) -> DataFrame:
    """The `most` highest scores of each key; scores are digits of any length, compared as numbers."""
    size = F.length(F.ltrim("score", F.lit("-")))
    negative = F.col("score").startswith("-")
    # In falling order: positive before negative, longer before shorter, then by digits; reversed for negative ones.
    order = [negative.asc(), F.when(negative, -size).otherwise(size).desc(), F.when(~negative, F.col("score")).desc(), F.col("score").asc(), F.col(tie).asc()]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)
