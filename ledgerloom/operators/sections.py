"""Sections of a filing's lines, and chunk records, as windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

#: Fixed patterns: headers of parts and items, titles after the last item, and the mark around a row block.
PART = r"(?i)^PART\s+([IVX]{1,4})\.?\s*$"
ITEM = r"(?i)^Item\s+(\d{1,2}[A-Za-z]?)\.\s*(\S.*)$"
BACK_MATTER = {
    "Financial Statements": r"(?i)^INDEX\s+TO\s+(?:CONSOLIDATED\s+)?FINANCIAL\s+STATEMENTS$",
    "Signatures": r"(?i)^SIGNATURES$",
    "Exhibit Index": r"(?i)^(EXHIBIT\s+INDEX|INDEX\s+OF\s+EXHIBITS)$",
}
FENCE, NO_HEADING = "```", "(no heading)"


def lines(docs: DataFrame, filing: str = "filing", text: str = "text") -> DataFrame:
    """(filing, seq, line) of whole texts; null text has no line."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n", -1)
    return docs.select(F.col(filing).alias("filing"), F.posexplode(parts).alias("seq", "line"))


def headed(rows: DataFrame) -> DataFrame:
    """rows (filing, seq, line) with keep, section (a number within the filing) and heading.

    The first line of a part starts a section and forgets the item; titled items, titles of statements and notes, and
    after part IV has begun the titles of the back matter start one too. Headers, page numbers and rules are not kept.
    What stands between fences is kept as it is and never read as a header.
    """
    w = Window.partitionBy("filing").orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    bare = T.trimmed(F.col("line"))
    df = rows.withColumn("_fence", F.startswith(bare, F.lit(FENCE)))
    df = df.withColumn("_inside", F.col("_fence") | (F.sum(F.col("_fence").cast("int")).over(so_far) % 2 == 1))
    open_line = ~F.col("_inside") & ~(bare.rlike(T.PAGE_NUMBER) | bare.rlike(T.RULE))
    df = df.withColumn("_part", F.when(open_line & bare.rlike(PART), F.upper(F.regexp_extract(bare, PART, 1))))
    first = F.row_number().over(Window.partitionBy("filing", "_part").orderBy("seq")) == 1
    df = df.withColumn("_new_part", F.when(F.col("_part").isNotNull() & first, F.concat(F.lit("PART "), "_part")))
    df = df.withColumn("_in_part", F.last("_new_part", ignorenulls=True).over(so_far))
    other = open_line & F.col("_part").isNull()
    title = other & T.is_statement_boundary(F.col("line"))
    item = F.when(other & ~title & bare.rlike(ITEM), F.concat(F.lit("Item "), F.regexp_extract(bare, ITEM, 1), F.lit(". "), F.regexp_extract(bare, ITEM, 2)))
    back = F.lit(None).cast("string")
    for name, pattern in BACK_MATTER.items():
        back = F.when(bare.rlike(pattern), F.lit(name)).otherwise(back)
    back = F.when(other & ~title & ~bare.rlike(ITEM) & (F.col("_in_part") == "PART IV"), back)
    df = df.withColumns({"_title": title, "_item": F.coalesce(item, back, F.when(F.col("_new_part").isNotNull(), F.lit("")))})
    starts = (F.col("_title") | F.col("_item").isNotNull()).cast("int")
    header = F.col("_part").isNotNull() | F.col("_item").isNotNull()
    keep = F.col("_inside") | (open_line & ~header & (F.col("_title") | ~bare.rlike(T.BARE_ITEM)))
    path = F.array(F.col("_in_part"), F.last("_item", ignorenulls=True).over(so_far))
    heading = F.array_join(F.filter(path, lambda x: x.isNotNull() & (x != "")), " > ")
    df = df.withColumns({"keep": keep, "section": F.sum(starts).over(so_far), "heading": F.coalesce(F.nullif(heading, F.lit("")), F.lit(NO_HEADING))})
    return df.select(*rows.columns, "keep", "section", "heading")


def sections(rows: DataFrame) -> DataFrame:
    """rows (filing, seq, line): (filing, section, heading, body) of the sections that have a body; section follows the text's order."""
    kept = headed(rows).where("keep")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    found = kept.groupBy("filing", "section").agg(F.first("heading").alias("heading"), T.trimmed(body).alias("body"))
    return found.where("body <> ''")


def records(chunks: DataFrame, template: str = "{}") -> DataFrame:
    """chunks (filing, seq, heading, content, statement_type, context): the rows of the index.

    Keys run from 1 over filings in order and their chunks. A chunk without a type of its own has that of the last
    title of a statement in it or before it in the filing; the title of the notes ends it. The embedding text opens with
    the context line, if there is one.
    """
    said = F.transform(F.split("content", "\n"), lambda x: F.when(T.is_notes_title(x), F.lit("")).otherwise(T.statement_title(x)))
    last = F.try_element_at(F.filter(said, lambda x: x.isNotNull()), F.lit(-1))
    so_far = Window.partitionBy("filing").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    typed = chunks.withColumn("_said", F.nullif(F.last(last, ignorenulls=True).over(so_far), F.lit("")))
    # Keys without one window over all chunks: a place within the filing, plus the chunks of the filings before it.
    sizes = chunks.groupBy("filing").agg(F.count(F.lit(1)).alias("_n"))  # a row for each filing
    floors = sizes.withColumn("_floor", F.coalesce(F.sum("_n").over(Window.orderBy("filing").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = typed.withColumn("_at", F.row_number().over(Window.partitionBy("filing").orderBy("seq"))).join(floors, "filing")
    body = T.embedding_text(F.col("heading"), F.col("content"))
    before, _, after = template.partition("{}")
    text = F.concat(F.lit(before), F.concat_ws("\n", "context", body), F.lit(after))
    return placed.select((F.col("_floor") + F.col("_at")).cast("int").alias("key"), F.col("filing").alias("source_filing"), "heading", F.coalesce("statement_type", "_said", F.lit("narrative")).alias("statement_type"), "content", text.alias("embedding_text"))
