"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number u in (0, 1) for a key from a hash of key and shard; the shard with the
largest -weight / ln(u) takes the key. The draw of one shard does not depend on the others, so a
further shard takes keys only into itself, and each shard's share follows its weight.

A record's slot within its shard is gapless from 0. Shards are far fewer than tasks, so numbering
goes over (shard, bucket of the key hash) groups: positions within a group, plus the sizes of the
groups before it, of which there are shards x buckets at most.

Defined results: a null key is hashed as the text `null`; null text has 0 bytes and the checksum of
no bytes; repeated rows get slots of their own (equal rows in any order); an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256
#: Hex digits of the hash that make up the draw: 48 bits, exact in a double.
_DIGITS = 12


def draw(key: Column, shard: int) -> Column:
    """u in (0, 1), the same for a key and shard wherever it is computed."""
    digits = F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def rendezvous(key: Column, weights: Sequence[float], more: float | None = None) -> tuple[Column, Column | None]:
    """The shard of a key over the weights, and its shard with one more of weight `more`; ties go to the smaller shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight over 0")
    scored = lambda i, w: F.struct((-F.lit(float(w)) / F.ln(draw(key, i))).alias("score"), F.lit(-i).alias("shard"))
    best = F.array_max(F.array(*(scored(i, w) for i, w in enumerate(weights))))
    shard = (-best["shard"]).cast("int")
    return shard, None if more is None else (-F.greatest(best, scored(len(weights), more))["shard"]).cast("int")


def shard(
    rows: DataFrame,
    key: str,
    weights: Sequence[float],
    more: float | None = None,
    carried: dict[str, Column] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(key, carried..., shard, slot, grown_shard); carried: further columns by name, computed before any exchange."""
    own, grown = rendezvous(F.col("_key"), weights, more)
    thin = rows.select(F.col(key).alias("_key"), *((v.alias(k) for k, v in (carried or {}).items())))
    placed = thin.withColumns({"shard": own, "grown_shard": F.lit(None).cast("int") if grown is None else grown, "_bucket": F.pmod(F.xxhash64(F.col("_key"), F.lit(0), *(F.col(c) for c in carried or {})), F.lit(buckets)).cast("int")})
    counts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    floors = counts.withColumn("_floor", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # shards x buckets rows at most
    within = Window.partitionBy("shard", "_bucket").orderBy("_key", *(carried or {}))
    numbered = placed.withColumn("_at", F.row_number().over(within) - 1).join(F.broadcast(floors), ["shard", "_bucket"])
    return numbered.select(F.col("_key").alias(key), *(carried or {}), "shard", (F.col("_floor") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
