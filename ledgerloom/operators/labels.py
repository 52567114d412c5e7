"""Labels that blocks and rows get from a taxonomy and from each other: statements of roles and tables, periods of
rows, paragraphs over page breaks, sections of typed blocks.

What the rules forbid is a row's `problem`, so that one damaged filing does not stop the others; `raised` stops at the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import period_label

#: Fixed values, tried in order: statement type, words of its title, concepts that it has to present.
STATEMENTS = (
    ("comprehensive_income", ("COMPREHENSIVE",), ("us-gaap:ComprehensiveIncomeNetOfTax",)),
    ("cash_flow_statement", ("CASH FLOW",), ("us-gaap:NetCashProvidedByUsedInOperatingActivities",)),
    ("balance_sheet", ("BALANCE SHEET", "FINANCIAL POSITION", "FINANCIAL CONDITION"), ("us-gaap:Assets", "us-gaap:LiabilitiesAndStockholdersEquity")),
    ("equity_statement", ("EQUITY",), ("us-gaap:StatementEquityComponentsAxis",)),
    ("income_statement", ("INCOME", "OPERATIONS", "EARNINGS"), ("us-gaap:EarningsPerShareBasic",)),
)
#: The share of a role's concepts that its table has to cover, and a paragraph that is a page number.
LEAST_COVERAGE, PAGE_NUMBER = 0.4, r"^(?:F-)?\d{1,4}$"


def raised(df: DataFrame) -> DataFrame:
    """The rows without `problem`, once none of them has any; the first one stops the job."""
    return df.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")))).where("problem is null").drop("problem")


def role_types(roles: DataFrame, presented: DataFrame, statements=STATEMENTS) -> DataFrame:
    """(filing, role, type, problem) for primary roles (filing, role, title) and what they present (filing, role, concept).

    A title's words choose the type, the type's concepts have to be presented. A role that reads as comprehensive
    income but presents the income statement's concepts too is the income statement of both. Each filing has each type once.
    """
    named = {t: (words, concepts) for t, words, concepts in statements}
    checks = sorted({c for _, _, concepts in statements for c in concepts})
    held = presented.where(F.col("concept").isin(checks)).groupBy("filing", "role").agg(F.collect_set("concept").alias("held"))  # no more than the checks
    own = roles.join(held, ["filing", "role"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    title = F.upper("title")
    kind = F.lit(None).cast("string")
    for t, words, _ in reversed(statements):
        matches = F.lit(False)
        for w in words:
            matches = matches | F.contains(title, F.lit(w))
        kind = F.when(matches, t).otherwise(kind)
    has = lambda t: F.forall(F.array(*(F.lit(c) for c in named[t][1])), lambda c: F.array_contains("held", c))
    own = own.withColumn("_title", kind).withColumn("_both", (F.col("_title") == "comprehensive_income") & has("income_statement"))
    own = own.withColumn("type", F.when(F.col("_both"), "income_statement").otherwise(F.col("_title")))
    confirmed = F.lit(False)
    for t in named:
        confirmed = F.when(F.col("type") == t, has(t)).otherwise(confirmed)
    filing = Window.partitionBy("filing")
    twice = F.count(F.lit(1)).over(Window.partitionBy("filing", "type")) > 1
    wanted = F.array(*(F.lit(t) for t in named))
    # A combined income statement leaves no other to be found.
    expected = F.when(F.max(F.coalesce("_both", F.lit(False))).over(filing), F.array_remove(wanted, "comprehensive_income")).otherwise(wanted)
    missing = F.array_sort(F.array_except(expected, F.collect_set("type").over(filing)))
    problem = F.coalesce(
        F.when(F.col("type").isNull(), F.concat(F.lit("no type by its title: "), F.coalesce("title", F.lit("(null)")))),
        F.when(~confirmed, F.concat(F.lit("does not present the concepts of "), "type")),
        F.when(twice, F.concat(F.lit("two roles of "), "type")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))),
    )
    return own.select("filing", "role", "type", problem.alias("problem"))


def statement_tables(tables: DataFrame, roles: DataFrame, presented: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """(filing, role, type, table, coverage, problem) from tagged concepts of tables (filing, table, concept), roles (filing, role, type) and what they present.

    A role goes to the table with the largest share of its concepts, the first of several. A share below `least`, or a table that is
    the best of two roles, is a problem.
    """
    want = presented.select("filing", "role", "concept").distinct().join(roles.select("filing", "role"), ["filing", "role"], "left_semi")
    total = want.groupBy("filing", "role").agg(F.count(F.lit(1)).alias("_all"))
    met = want.join(tables.select("filing", "table", "concept").distinct(), ["filing", "concept"]).groupBy("filing", "role", "table").agg(F.count(F.lit(1)).alias("_n"))
    best = met.groupBy("filing", "role").agg(F.min(F.struct((-F.col("_n")).alias("n"), "table")).alias("b"))
    own = roles.select("filing", "role", "type").join(total, ["filing", "role"], "left").join(best, ["filing", "role"], "left")
    own = own.withColumns({"table": F.col("b.table"), "coverage": F.coalesce(-F.col("b.n") / F.col("_all"), F.lit(0.0))})
    shared = F.collect_set("type").over(Window.partitionBy("filing", "table"))
    problem = F.when(F.col("coverage") < least, F.concat(F.lit("no table covers "), "type")).when(F.size(shared) > 1, F.concat(F.lit("one table for "), F.array_join(F.array_sort(shared), " and ")))
    return own.select("filing", "role", "type", "table", "coverage", problem.alias("problem"))


def row_periods(rows: DataFrame, values: DataFrame, contexts: DataFrame, fiscal: bool = False) -> DataFrame:
    """rows (filing, table, row, label, grp) with `label` naming the period, where a table's rows have several and a row does not show its own.

    values (filing, table, row, column, context) and contexts (filing, context, start, end, instant). A row's period
    is the one that all its tagged values share; with two distinct ones or more in a table each labelled row gets its
    own, unless its group, label or columns show the year. With `fiscal`, contexts has fiscal_year, null for calendar years.
    """
    period = F.struct("start", F.coalesce("instant", "end").alias("end"), *(["fiscal_year"] if fiscal else [F.lit(None).cast("int").alias("fiscal_year")]))
    known = contexts.select("filing", "context", period.alias("period"))
    tagged = values.where("context is not null").join(known, ["filing", "context"])
    each = tagged.groupBy("filing", "table", "row").agg(F.count_distinct("period").alias("_n"), F.first("period").alias("period")).where("_n = 1")
    # Two distinct periods among a table's rows: the least and the greatest differ.
    ends = each.groupBy("filing", "table").agg(F.min("period").alias("_low"), F.max("period").alias("_high")).where("_low <> _high or (_low.start is null) <> (_high.start is null)")
    shown = values.groupBy("filing", "table", "row").agg(F.array_join(F.collect_set("column"), " ").alias("_columns"))
    own = rows.join(each.join(ends, ["filing", "table"], "left_semi").select("filing", "table", "row", "period"), ["filing", "table", "row"], "left").join(shown, ["filing", "table", "row"], "left")
    year = F.year("period.end").cast("string")
    shows = F.contains(F.concat_ws(" ", "grp", "label", "_columns"), year)
    said = period_label(F.col("period.start"), F.col("period.end"), F.col("period.fiscal_year"))
    label = F.when(F.col("period").isNotNull() & (F.col("label") != "") & ~shows, F.concat("label", F.lit(" ("), said, F.lit(")"))).otherwise(F.col("label"))
    return own.select(*(label.alias("label") if c == "label" else F.col(c) for c in rows.columns))


def ends_sentence(text: Column) -> Column:
    """Whether a paragraph ends with a mark that ends or introduces, closing quotes and brackets aside."""
    return F.regexp_replace(text, "[”\"’)]+$", "").rlike(r"[.?!:;]$")


def joined_paragraphs(blocks: DataFrame) -> DataFrame:
    """(doc, seq, text, topic, pieces): paragraphs (doc, seq, kind, text, topic) that a page or column break cut are one again.

    A text that does not end a sentence goes on in the next block, page numbers between them skipped, if that is a text of
    the same topic and begins in lower case; of a hyphenated end nothing comes between. A joined paragraph has the place
    of its first piece; page numbers, and other blocks, stay where they are. Empty texts join nothing.
    """
    number = (F.col("kind") == "text") & F.coalesce(F.col("text"), F.lit("")).rlike(PAGE_NUMBER)
    plain = blocks.withColumn("_number", number)
    order = Window.partitionBy("doc").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("kind") == "text") & (F.col("kind") == "text") & ~ends_sentence(before("text")) & (before("text") != "") & F.col("text").rlike(r"^\p{Ll}") & before("topic").eqNullSafe(F.col("topic"))
    own = plain.where("not _number").withColumns({"_begins": (~F.coalesce(goes_on, F.lit(False))).cast("int"), "_glue": F.when(before("text").rlike("[-—–]$"), "").otherwise(" ")})
    own = own.withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "_begins", "_glue", "text"))), F.array().cast("array<string>"), lambda a, x: F.concat(a, F.when(x["_begins"] == 1, F.array(x["text"])).otherwise(F.array(x["_glue"], x["text"]))))
    joined = own.groupBy("doc", "_run").agg(F.min("seq").alias("at"), F.min_by("kind", "seq").alias("kind"), F.when(F.count("text") > 0, F.array_join(said, "")).alias("said"), F.min_by("topic", "seq").alias("topic"), F.count(F.lit(1)).cast("int").alias("pieces"))
    numbers = plain.where("_number").select("doc", F.col("seq").alias("at"), "kind", F.col("text").alias("said"), "topic", F.lit(1).alias("pieces"))
    return joined.select("doc", "at", "kind", "said", "topic", "pieces").union(numbers).withColumnsRenamed({"at": "seq", "said": "text"})


def block_sections(blocks: DataFrame) -> DataFrame:
    """blocks (doc, seq, kind, topic, statement_type, starts) with `section`, from 1.

    A section begins where the topic changes, where `starts` holds (a heading or title), and with a second
    statement's table, which takes along what came since the table before it.
    """
    order = Window.partitionBy("doc").orderBy("seq")
    changes = F.lag(F.lit(1)).over(order).isNull() | F.coalesce("starts", F.lit(False)) | ~F.lag("topic").over(order).eqNullSafe(F.col("topic"))
    own = blocks.withColumn("_base", changes.cast("int")).withColumn("_base", F.sum("_base").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = Window.partitionBy("doc", "_base").orderBy("seq")
    statement = F.col("statement_type").isNotNull() & (F.col("kind") == "table")
    earlier = F.coalesce(F.count_if(statement).over(base.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    next_table = F.first(F.when(F.col("kind") == "table", statement), True).over(base.rowsBetween(0, Window.unboundedFollowing))
    moves = earlier & F.coalesce(next_table, F.lit(False)) & (F.lag("kind").over(base) == "table")
    own = own.withColumn("_starts", (F.lag(F.lit(1)).over(base).isNull() | moves).cast("int"))
    return own.withColumn("section", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).select(*blocks.columns, "section")


def section_statement(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, statement_type, problem): the one statement of the tables, `narrative` without any; two are a problem."""
    found = blocks.groupBy(*by).agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "table", F.col("statement_type")))).alias("t"))
    kind = F.when(F.size("t") == 0, "narrative").when(F.size("t") == 1, F.get("t", F.lit(0)))
    return found.select(*by, kind.alias("statement_type"), F.when(F.size("t") > 1, F.concat(F.lit("tables of "), F.array_join("t", " and "))).alias("problem"))
