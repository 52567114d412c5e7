"""Filings, question files and stored indexes as DataFrames, and their sinks with checks."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_\-]+)""", re.I)
HIDDEN_HEADER = r"(?is)<ix:header\b[^>]*>.*?</ix:header>"
EXPECTED = (
    "questions array<struct<id:string,question:string,kind:string,expect:array<string>,unit:string,conflicts:array<string>,traps:array<string>,"
    "accept:array<struct<value:string,if_label:string>>,exact:boolean,chunk_expect:array<string>,trap_why:map<string,string>,decline_ok:boolean>>"
)


def decode(content: bytes) -> str:
    """A UTF-8 mark wins, else the charset that the first 4,096 bytes declare; UTF-8 where it is unknown. Bytes that do not fit are replaced."""
    if content.startswith(codecs.BOM_UTF8):
        return content.decode("utf-8-sig", "replace")
    said = _META.search(content[:4096])
    try:
        name = codecs.lookup(said[1].decode()).name if said else "utf-8"
    except LookupError:
        name = "utf-8"
    return content.decode(name, "replace")


def read_filings(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """(filing, sha256, html) for every file, decoded by what it declares; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    if not files.select("path").head(1):
        raise FileNotFoundError(f"no {pattern} in {folder}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("filing"), batch.column("sha256"), pa.array([decode(c) for c in batch.column("content").to_pylist()], pa.string())], ["filing", "sha256", "html"])

    return files.select(F.element_at(F.split("path", "/"), -1).alias("filing"), F.sha2("content", 256).alias("sha256"), "content").mapInArrow(run, "filing string, sha256 string, html string")


def without_hidden_header(html):
    return F.regexp_replace(html, HIDDEN_HEADER, "")


def write_index(records: DataFrame, path: str) -> int:
    """Writes chunk records and counts what is there; another number than was given is an error."""
    if records.where(F.col("key").isNull() | (F.col("key") < 1)).head(1):
        raise ValueError("keys start at 1")
    given = records.count()
    records.write.mode("overwrite").parquet(path)
    stored = records.sparkSession.read.parquet(path).count()
    if stored != given:
        raise RuntimeError(f"{stored} of {given} records are stored")
    return stored


def read_index(spark: SparkSession, path: str, columns: tuple[str, ...] = ("source_filing", "heading", "content")) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_review(records: DataFrame, path: str) -> None:
    """A text for each filing: its chunks with key and heading, in order."""
    block = F.format_string("=== %d | %s | %s ===\n%s\n", "key", "heading", "statement_type", "content")
    records.repartition("source_filing").sortWithinPartitions("source_filing", "key").select("source_filing", block.alias("value")).write.mode("overwrite").partitionBy("source_filing").text(path)


def index_path(root: str, strategy: str, model: str, budget: int, default_budget: int = 500) -> str:
    """A folder of its own for each way to build an index; the default budget has no suffix."""
    slug = re.sub(r"[^A-Za-z0-9._-]+", "-", model)
    return f"{root.rstrip('/')}/index/{strategy.lower()}/{slug}" + (f"-{budget}" if budget != default_budget else "")


def manifest(filings: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One row: the settings, and hashes, the map from file to hash in the order of names. filings (filing, sha256): the files of one index."""
    hashes = F.map_from_entries(F.array_sort(F.collect_list(F.struct("filing", "sha256")))).alias("hashes")
    return filings.agg(hashes).select(*(F.lit(v).alias(k) for k, v in settings.items()), "hashes")


def save_manifest(built: DataFrame, path: str) -> None:
    """Written last, so that an index without it was never finished."""
    built.coalesce(1).write.mode("overwrite").json(path)


def load_manifest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The stored manifest, or None if it is missing or cannot be read."""
    from pyspark.errors import PySparkException

    try:
        found = spark.read.schema(like.schema).option("mode", "FAILFAST").json(path)
        return found if found.where("hashes is not null").head(1) else None
    except (PySparkException, OSError):
        return None


def differences(built: DataFrame, now: DataFrame) -> DataFrame:
    """(what, built, now): settings that changed, then files added, removed or changed. No row: the index still holds."""
    names = [c for c in now.columns if c != "hashes"]
    long = lambda df, as_: df.select(F.explode(F.map_concat(F.create_map(*(x for c in names for x in (F.lit(f"setting {c}"), F.col(c).cast("string")))), F.transform_keys("hashes", lambda k, _: F.concat(F.lit("file "), k)))).alias("what", as_))
    both = long(built, "built").join(long(now, "now"), "what", "full_outer")
    return both.where(~F.col("built").eqNullSafe(F.col("now")))


def read_expected(spark: SparkSession, path: str) -> DataFrame:
    """A row for each expected answer; a repeated id is an error."""
    rows = spark.read.schema(EXPECTED).option("multiLine", True).json(path).select(F.inline("questions"))
    if rows.groupBy("id").count().where("count > 1").head(1):
        raise ValueError("an id is there twice")
    return rows


def read_questions(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Lines of a question file that are not blank, joined to the expected answers of exactly that text; one without is an error."""
    asked = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("question")).distinct()
    unknown = asked.join(expected, "question", "left_anti").head(1)
    if unknown:
        raise ValueError(f"no expected answer for: {unknown[0]['question']}")
    return expected.join(asked, "question", "left_semi")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored runs, all iterations: (scenario, iteration, execution, created, metrics, tags)."""
    schema = "scenarioName string, iterationName string, executionName string, creationTime timestamp, evaluationResult struct<metrics:map<string,struct<value:string,reason:string>>>, tags array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.select(F.col("scenarioName").alias("scenario"), F.col("iterationName").alias("iteration"), F.col("executionName").alias("execution"), F.col("creationTime").alias("created"), F.col("evaluationResult.metrics").alias("metrics"), "tags")
