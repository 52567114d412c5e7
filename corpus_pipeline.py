"""From raw documents to packed training sequences, in five stages over documents.

Language identification drops documents without an identifiable language, toxicity those predicted
toxic, near-dedup all but one document of each group; secret scans replace secrets in the text; packing
gives the pieces of the training sequences. Each stage is written as Parquet and read again.

Stages that use Python workers bound the bytes of the Arrow batches that go there, for the session from then
on: executors and workers hold whole batches, and Spark's own bound is 64 MB for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, packing, secrets, simhash, toxicity
from ledgerloom.llm.bpe import BATCH_BYTES
from ledgerloom.storage import delete, shared_dir, table

#: Below this share of agreement with the nearest profile a text is in none of the learned languages.
LEAST_SCORE = 0.15
BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Batches of what operators take at a time, one row at least; a bound that the session has already stays."""
    if spark.conf.get(BATCH_BOUND, None) is None:
        spark.conf.set(BATCH_BOUND, str(BATCH_BYTES))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with columns named by number, so that none clashes with what an operator adds, and the name of the text."""
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), f"c{docs.columns.index('text')}"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is in one of the languages that the labelled documents teach.

    Null and empty texts, texts without a letter and those too far from every language go; where nothing
    is labelled all go. Repeated rows are judged alike, very long texts whole; an empty table stays empty.
    """
    _small_batches(spark)
    own, text = _numbered(docs)
    found = langid.identify(own, F.lit(True), text, f"c{docs.columns.index('lang')}", keep=tuple(own.columns))
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*own.columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the severity model does not find toxic.

    Null and empty texts have no word that could be toxic and are judged by the model's base severity;
    without labels of both classes all stay. Repeated rows are judged alike, very long texts whole.
    """
    _small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    own, text = _numbered(docs)
    return toxicity.score(own, model, tuple(own.columns), text).where("not toxic").select(*own.columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group of near copies.

    Null and empty texts are one group; rows without an id all stay; repeated rows stay once; of several
    texts of the least id in a group that with the least digest stays; very long texts are compared whole.
    """
    _small_batches(spark)
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; n_chars follows the text.

    All rows stay, null text as null with the n_chars that it had; repeated rows are treated alike.
    """
    own, text = _numbered(docs)
    changed = {text: secrets.redacted(text)}
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}"
        changed[n] = F.coalesce(F.length(text).cast(docs.schema["n_chars"].dataType), F.col(n))
    found = secrets.scan(own, text).select(*own.columns, "_spans").withColumn(text, changed.pop(text))
    return found.withColumns(changed).select(*own.columns).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 4096 tokens; null text is empty, its document its end token alone; repeated rows are packed once each."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage read is deleted when its result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
