"""The answer guard as a stream: stopped, restarted, and equal to the batch over the same events."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerloom.streaming import answers as A
from ledgerloom.streaming.guard import outcome

SCHEMA = "answer_id long, seq long, text string, finish_reason string, ts timestamp"


def tokens_of(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    finish = F.when(F.col("event_type") == "error", "content_filter").when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0), "length")
    rows = e.select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("seq"), F.when((F.col("value") > 15) & (F.col("user_id") % 3 > 0), "x").otherwise("").alias("text"), F.when(F.col("user_id") % 7 > 0, finish).alias("finish_reason"), "ts")
    return rows.union(spark.createDataFrame([(None, 1, "x", None, datetime.datetime(2024, 1, 1)), (10**6, 1, "x", None, datetime.datetime(2024, 1, 2)), (10**6 + 1, 1, "", "length", datetime.datetime(2024, 1, 1))], SCHEMA))


def test_a_restarted_stream_ends_as_the_batch(spark, tmp_path):
    rows = tokens_of(spark).orderBy("ts").cache()
    n = rows.count()
    source, out, checkpoint = (f"file://{tmp_path}/{d}" for d in ("in", "out", "checkpoint"))
    place = F.row_number().over(__import__("pyspark").sql.Window.orderBy("ts", "seq"))
    placed = rows.withColumn("_p", place).cache()
    put = lambda low, high: placed.where(F.col("_p").between(low + 1, high)).drop("_p").coalesce(1).write.mode("append").parquet(source)
    start = lambda: A.write_outcomes(A.outcomes(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), timeout_ms=3_600_000), out, checkpoint)
    put(0, n // 3)
    first = start()
    first.awaitTermination(120)
    assert not first.isActive
    put(n // 3, 2 * n // 3)
    put(2 * n // 3, n)
    # What is far in the future lets the timers of all others run out.
    for seq in (1, 2):
        spark.createDataFrame([(-1, seq, "x", None, datetime.datetime(2030, 1, seq))], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    second = start()
    second.awaitTermination(180)
    assert not second.isActive and second.id == first.id
    got = {r["answer_id"]: (r["outcome"], r["finished"]) for r in A.latest(spark, out).collect() if r["answer_id"] != -1}
    reasons = rows.where("answer_id is not null").groupBy("answer_id").agg((F.count("finish_reason") > 0).alias("finished"))
    want = {r["answer_id"]: (r["outcome"], r["finished"]) for r in outcome(rows.where("answer_id is not null")).join(reasons, "answer_id").collect()}
    assert got == want and {o for o, _ in want.values()} == {"ok", "filtered", "starved"} and not all(f for _, f in want.values())


def test_batches_that_repeat_replace_themselves(spark, tmp_path):
    for outcome_ in ("starved", "ok"):
        df = spark.createDataFrame([(1, outcome_, True, datetime.datetime(2024, 1, 1), 0)], f"{A.OUT}, batch long")
        df.write.mode("overwrite").parquet(f"file://{tmp_path}/o/part=0")
    assert [tuple(r) for r in A.latest(spark, f"file://{tmp_path}/o").collect()] == [(1, "ok", True)]
