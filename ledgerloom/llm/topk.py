"""Exact top-k by inner product: term-at-a-time accumulation over dense score arrays.

Vectors become integer weights, floor(scale * x). A block of candidates is kept as postings: for each
term (component) the places and weights of the candidates that have it. For a block of queries an
array of scores is filled term by term: the queries with that term scatter its weighted postings into
their rows. Partition selection takes each query's k best of the block, and the blocks' winners merge.

Blocks: candidates fall into groups of about `group` rows by a hash of their id, queries into groups
of about `batch`; each pair of groups is one task's work, so neither side is ever held whole.

Defined results: vectors that are null, hold null or a non-finite component take no part, nor do null
ids; vectors of different lengths are padded with zeros; rows with a query's own id are never its
candidates; a repeated query row is answered once, and different vectors under one id are queries of
their own; an empty table gives no rows. Ties go to the smaller id. Scores are exact: blocks whose sums
might leave 64 bits are computed with Python's integers, and only a score among the k best that no long
can hold raises.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, SCALE, GROUP, BATCH = 5, 256, 16_384, 1024


def _matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Weights floor(scale * x) of a list column, shorter rows padded with zeros: as int64, or as Python integers if they are large."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(array.offsets))
    values = np.asarray(array.flatten(), np.float64)
    wide = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), wide), np.float64)
    out[np.arange(wide)[None, :] < lengths[:, None]] = values
    if np.abs(out).max(initial=0) * scale < 2**62:
        return np.floor(out * scale).astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) < 2**52 else int(x) * scale for x in row] for row in out.tolist()]
    return np.array(exact, object).reshape(out.shape)


def block_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query index, row index, score) of each query's k best rows; row_ids ascend."""
    terms = min(queries.shape[1], rows.shape[1])
    most = lambda m: [max(map(abs, m[:, t].tolist()), default=0) for t in range(terms)]
    bound = sum(a * b for a, b in zip(most(queries), most(rows), strict=True))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**62 else object
    q, r = queries.astype(kind), rows.astype(kind)
    found = []
    step = max(1, 4_000_000 // max(1, len(row_ids)))
    for low in range(0, len(q), step):
        part = q[low : low + step]
        scores = np.zeros((len(part), len(row_ids)), kind)
        for t in range(terms):
            have, posted = np.flatnonzero(part[:, t]), np.flatnonzero(r[:, t])
            if 2 * len(posted) > len(row_ids):  # a posting list that is nearly full is added as it stands
                weights = np.ascontiguousarray(r[:, t])
                for i in have:
                    scores[i] += part[i, t] * weights
            elif len(posted):
                weights = r[posted, t]
                for i in have:
                    scores[i, posted] += part[i, t] * weights
        for i in range(len(part)):
            own = scores[i]
            mine = np.flatnonzero(row_ids == query_ids[low + i])
            valid = len(own) - len(mine)
            take = min(k, valid)
            if not take:
                continue
            if kind is object:
                order = heapq.nsmallest(take, (p for p in range(len(own)) if row_ids[p] != query_ids[low + i]), key=lambda p: (-own[p], p))
                found += [(low + i, p, int(own[p])) for p in order]
                continue
            own = own.astype(np.int64)
            if len(mine):
                own[mine] = np.iinfo(np.int64).min
            least = np.partition(own, len(own) - take)[len(own) - take]
            over, level = np.flatnonzero(own > least), np.flatnonzero(own == least)
            picked = np.concatenate([over, level[: take - len(over)]])
            found += [(low + i, p, int(own[p])) for p in picked.tolist()]
    return found


def topk(
    queries: DataFrame, candidates: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, scale: int = SCALE, group: int = GROUP, batch: int = BATCH
) -> DataFrame:
    """(query_id, rank, id, score): the k best candidates of every query row."""

    def weighed(df: DataFrame) -> DataFrame:
        v = F.col(vector_column)
        finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        own = df.select(F.col(id_column).cast("long").alias("id"), v.alias(vector_column)).where(F.col("id").isNotNull() & v.isNotNull())
        return own.where(finite).select("id", F.transform(v, lambda x: x.cast("double")).alias("w"))

    own, asked = weighed(candidates), weighed(queries).distinct()
    groups = max(1, -(-candidates.count() // group))
    batches = max(1, -(-queries.count() // batch))
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("of", F.xxhash64("w")).withColumn("b", place(batches, 1)).withColumn("g", every(groups))
    right = own.withColumn("g", place(groups, 2)).withColumn("b", every(batches))

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        names = ["query_id", "of", "vec_id", "score"]
        schema = pa.schema([(n, pa.int64()) for n in names])
        if not q.num_rows or not r.num_rows:
            return schema.empty_table()
        order = np.argsort(np.asarray(r["id"]), kind="stable")
        ids, asked_ids, of = np.asarray(r["id"])[order], np.asarray(q["id"]), np.asarray(q["of"])
        found = block_topk(_matrix(q["w"], scale), asked_ids, _matrix(r["w"], scale)[order], ids, k)
        asked = [f[0] for f in found]
        return pa.Table.from_arrays([pa.array(asked_ids[asked]), pa.array(of[asked]), pa.array(ids[[f[1] for f in found]]), pa.array([f[2] for f in found], pa.int64())] if found else [pa.array([], pa.int64())] * 4, schema=schema)

    best = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, "query_id long, of long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "of").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_column), "score")
