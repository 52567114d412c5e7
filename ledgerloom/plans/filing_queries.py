"""Registered queries over sections, chunks and records. Lines stand for events: their types become headers, titles and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import chunking as C
from ledgerloom.operators import sections as S
from ledgerloom.plans.registry import query
from ledgerloom.sources.blocks import blocks
from ledgerloom.storage import table

_LINE = """CASE event_type WHEN 'signup' THEN 'PART ' || (['I', 'II', 'III', 'IV'])[event_id % 4 + 1] WHEN 'purchase' THEN 'Item ' || (event_id % 15) || '. Topic ' || event_id
 WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'SIGNATURES' WHEN 1 THEN 'CONSOLIDATED BALANCE SHEETS' ELSE 'Notes to Financial Statements' END
 WHEN 'click' THEN CASE event_id % 5 WHEN 0 THEN 'F-' || (event_id % 900) WHEN 1 THEN '---' WHEN 2 THEN 'Item 1' ELSE 'text ' || event_id END ELSE 'Words of ' || event_id END"""
_HEADED = f"""l AS (SELECT user_id AS filing, event_id AS seq, {_LINE} AS line FROM events),
a AS (SELECT *, regexp_full_match(line, '(?:F-)?\\d{{1,4}}|---') AS noise, CASE WHEN starts_with(line, 'PART ') THEN line END AS part FROM l),
b AS (SELECT *, CASE WHEN part IS NOT NULL AND row_number() OVER (PARTITION BY filing, part ORDER BY seq) = 1 THEN part END AS new_part FROM a),
c AS (SELECT *, last_value(new_part IGNORE NULLS) OVER (PARTITION BY filing ORDER BY seq ROWS UNBOUNDED PRECEDING) AS in_part FROM b),
d AS (SELECT *, line IN ('CONSOLIDATED BALANCE SHEETS', 'Notes to Financial Statements') AS title,
  CASE WHEN regexp_full_match(line, 'Item \\d+\\. .*') THEN line WHEN line = 'SIGNATURES' AND in_part = 'PART IV' THEN 'Signatures' WHEN new_part IS NOT NULL THEN '' END AS item FROM c),
e AS (SELECT *, sum(CASE WHEN title OR item IS NOT NULL THEN 1 ELSE 0 END) OVER w AS section, nullif(last_value(item IGNORE NULLS) OVER w, '') AS in_item,
  NOT noise AND part IS NULL AND item IS NULL AND line <> 'Item 1' AS keep FROM d WINDOW w AS (PARTITION BY filing ORDER BY seq ROWS UNBOUNDED PRECEDING)),
sections AS (SELECT filing, CAST(section AS BIGINT) AS section, coalesce(nullif(concat_ws(' > ', any_value(in_part), any_value(in_item)), ''), '(no heading)') AS heading, string_agg(line, chr(10) ORDER BY seq) AS body FROM e WHERE keep GROUP BY ALL)"""


def _lines(spark, d) -> DataFrame:
    part = "element_at(array('I', 'II', 'III', 'IV'), cast(event_id % 4 + 1 as int))"
    return table(spark, d, "events").select(F.col("user_id").alias("filing"), F.col("event_id").alias("seq"), F.expr(_LINE.replace("(['I', 'II', 'III', 'IV'])[event_id % 4 + 1]", part)).alias("line"))


@query("section_split", f"WITH {_HEADED} SELECT filing, section, heading, body FROM sections")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return S.sections(_lines(spark, d))


@query("chunk_records", f"""WITH {_HEADED}, t AS (SELECT filing, seq, CASE line WHEN 'CONSOLIDATED BALANCE SHEETS' THEN 'balance_sheet' WHEN 'Notes to Financial Statements' THEN '' END AS said, line FROM l),
s AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY filing ORDER BY seq ROWS UNBOUNDED PRECEDING) AS state FROM t)
SELECT CAST(row_number() OVER (ORDER BY filing, seq) AS INTEGER) AS key, filing AS source_filing, 'H' AS heading, coalesce(nullif(state, ''), 'narrative') AS statement_type, line AS content, 'H' || chr(10) || chr(10) || line AS embedding_text FROM s""")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return S.records(_lines(spark, d).select("filing", "seq", F.lit("H").alias("heading"), F.col("line").alias("content"), none.alias("statement_type"), none.alias("context")))


@query("chunk_budget")
def chunk_budget(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as sections, packed to 200 tokens; held against invariants and golden cases in the tests."""
    docs = table(spark, d, "documents").select(F.col("source").alias("filing"), F.col("doc_id").alias("section"), F.col("lang").alias("heading"), F.col("text").alias("body"))
    return C.chunked(docs, 200, 20)


@query("html_blocks")
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of all pages; held against fixtures in the tests."""
    return blocks(table(spark, d, "pages"))
