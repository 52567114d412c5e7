"""Operators over ordered rows: carrying values along, gaps and islands, spans, nearest intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, group: str, order: list[str], value: Column, reset: Column, default: str, out: str) -> DataFrame:
    """The last value seen, back to the default at a reset."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(reset, F.lit("\x00")).otherwise(value), ignorenulls=True).over(w)
    return df.withColumn(out, F.coalesce(F.nullif(last, F.lit("\x00")), F.lit(default)))


def backfill_next(df: DataFrame, group: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Rows between the first and the last value take the next value."""
    base = Window.partitionBy(group).orderBy(*order)
    ahead, behind = base.rowsBetween(0, Window.unboundedFollowing), base.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.last(value, True).over(behind).isNotNull(), F.first(value, True).over(ahead)))


def islands(df: DataFrame, group: str, order: list[str], starts: Column, out: str) -> DataFrame:
    """Numbers stretches of rows, from 1; a stretch begins where `starts` holds."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_s", F.when(F.lag(F.lit(1)).over(w).isNull() | starts, 1).otherwise(0)).withColumn(out, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_s")


def outermost(spans: DataFrame, group: str, start: str, end: str, key: str) -> DataFrame:
    """Spans that no other span of the group holds: the furthest end so far, in order of start, is below their own."""
    w = Window.partitionBy(group).orderBy(F.col(start), F.col(end).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_far", F.max(end).over(w)).where(F.col("_far").isNull() | (F.col("_far") < F.col(end))).drop("_far")


def within_spans(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points joined to the spans that hold them, by equal buckets of `width` rather than by comparing all."""
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    return p.join(s, [group, "_b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_b")


def mode_low(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of several."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(by).agg(best.alias("b")).select(by, F.col("b.v").alias("mode"), (-F.col("b.n")).alias("n"))


def coverage(have: DataFrame, want: DataFrame, holder: str, role: str, concept: str, least: float = 0.4) -> DataFrame:
    """For each role the holder that has the largest share of its concepts, ties to the smaller; at least `least`."""
    have, want = have.select(holder, concept).distinct(), want.select(role, concept).distinct()
    total = want.groupBy(role).agg(F.count(F.lit(1)).alias("_all"))
    share = want.join(have, concept).groupBy(role, holder).agg(F.count(F.lit(1)).alias("_n")).join(total, role).withColumn("coverage", F.col("_n") / F.col("_all"))
    best = share.groupBy(role).agg(F.min(F.struct((-F.col("coverage")).alias("c"), F.col(holder).alias("h"))).alias("b"))
    return best.select(role, F.col("b.h").alias(holder), (-F.col("b.c")).alias("coverage")).where(F.col("coverage") >= least)


def first_wins(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(value, order).alias(value))


def changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys added, removed or changed between two maps."""
    both = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_io")).join(new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_in")), key, "full_outer")
    kind = F.when(F.col("_io").isNull(), "added").when(F.col("_in").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(key, kind.alias("change")).where("change is not null")
