"""The guard over answers as a stream: tokens with event times, outcomes as answers finish or time out.

State is one small row an answer: the last reason given and its place, whether any text came, and when. An
outcome is sent when it is first known and whenever later tokens change it; an answer that gives no reason within the
timeout after its last token is sent as `ok` and unfinished, and its state goes, as that of finished ones does then.

The sink writes each micro-batch to a folder of its own, so that one that is repeated after a restart overwrites
itself; `latest` reads the last outcome of every answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "answer_id long, outcome string, finished boolean, at timestamp"
STATE = "reason string, reason_seq long, said boolean, last_ms long, sent string"


def kind(reason: str | None, said: bool) -> str:
    """filtered by a content filter, starved if the length ended an answer without text, else ok."""
    return "filtered" if reason == "content_filter" else "starved" if reason == "length" and not said else "ok"


def outcomes(tokens: DataFrame, timeout_ms: int = 600_000, delay: str = "1 minute") -> DataFrame:
    """(answer_id, outcome, finished, at) from a stream of tokens (answer_id, seq, text, finish_reason, ts); ts may come late by `delay`.

    Null ids and times are left out; a null or empty text is no text; repeated tokens change nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        reason, seq, said, last, sent = state.get if state.exists else (None, None, False, 0, None)
        if state.hasTimedOut:
            state.remove()
            now = None if sent else kind(reason, said)
        else:
            for part in frames:
                said = said or bool((part["text"].fillna("") != "").any())
                last = max(last, int(part["ts"].max().timestamp() * 1000))
                given = part[part["finish_reason"].notna()]
                if len(given):
                    top = given.loc[given["seq"].idxmax()]
                    if seq is None or int(top["seq"]) >= seq:
                        reason, seq = str(top["finish_reason"]), int(top["seq"])
            now = kind(reason, said) if reason is not None else None
            changed = now is not None and now != sent
            sent = now if changed else sent
            state.update((reason, seq, said, last, sent))
            state.setTimeoutTimestamp(max(last + timeout_ms, state.getCurrentWatermarkMs() + 1))
            now = now if changed else None
        if now is not None:
            yield pd.DataFrame({"answer_id": [key[0]], "outcome": [now], "finished": [reason is not None], "at": [pd.Timestamp(last, unit="ms")]})

    plain = tokens.select(F.col("answer_id").cast("long").alias("answer_id"), F.col("seq").cast("long").alias("seq"), "text", "finish_reason", "ts").where("answer_id is not null and ts is not null")
    return plain.withWatermark("ts", delay).groupBy("answer_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def write_outcomes(found: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the stream into a folder; it goes on from its checkpoint, and a micro-batch that is repeated replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")

    return found.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(answer_id, outcome, finished): what was sent last of each answer."""
    rows = spark.read.schema(f"{OUT}, batch long, part int").option("basePath", path).parquet(path)
    return rows.groupBy("answer_id").agg(F.max_by("outcome", "batch").alias("outcome"), F.max_by("finished", "batch").alias("finished"))
