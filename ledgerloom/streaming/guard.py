"""A guard over streamed answers: rows (answer_id, seq, text, finish_reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome(tokens: DataFrame) -> DataFrame:
    """filtered if a content filter is the last reason given, even after text; starved if that is the length and no text came; else ok.

    Later rows without a reason change nothing; a null or empty text is no text. Works on a batch and, with
    output mode `update` or `complete`, on a stream.
    """
    last = F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col("seq")))
    said = F.max((F.coalesce("text", F.lit("")) != "").cast("int")) == 1
    kind = F.when(last == "content_filter", "filtered").when((last == "length") & ~said, "starved").otherwise("ok")
    return tokens.groupBy("answer_id").agg(kind.alias("outcome"))
