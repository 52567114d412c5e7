"""Tables as rows of cells: value pieces, columns, groups and their totals, and labelled lines.

A cell is a row (table, row, start, end, text, indent): the columns start to end (inclusive) that its text stands
over, and how far in the text begins. All steps are windows and equi joins by table; what is held at once is the header of
one table, never its rows. Every side of a join grows with the tables, and the planner sees only the files that it was written
to, many times smaller than their rows; so sides are merged, not broadcast, and no rows pass through the driver.

`pieces` joins `$ ( ) %` to the number beside them. `label_extent` finds where the labels of a table end.
`described` tells label, header and data rows apart. `leaves` are the columns that a header block stands for,
`nearest_columns` puts values under them. `grouped` decides which group a data row is in and where groups end. `lines`
puts it all together; a table that a rule cannot read, or that would lose a text, keeps its plain rows, with the reason.

Defined results: cells without text are left out; a table without a row of values is a text table of its
joined cells; rows and columns may have gaps; no cells give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.sequences import mode_low
from ledgerloom.storage import Shelf

# What counts as a number, a dash, a year that stands alone, units and a period.
NUMERIC = r"^\(?\$?\s*\(?\s*[-–—]?\s*\d[\d,]*(\.\d+)?\s*\)?\s*%?\s*\)?$"
DASHES = r"^[—–-]+$"
BARE_YEAR = r"^(19|20)\d{2}$"
UNITS = r"(?i)^\(?\s*(in|dollars in|amounts in|\$ in)\s+(millions|thousands|billions)"
PERIOD = (
    r"(?i)^((as of|as at|at|for the)\s+)?(((fiscal\s+)?(years?|quarters?|months|weeks)\s+ended,?)\s+)?"
    r"(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2},?\s+(19|20)\d{2}:?$|^(fiscal\s+(year\s+)?)?(19|20)\d{2}:?$"
)
OPENERS, CLOSERS, BULLETS = ("$", "(", "$(", "($"), (")", "%", ")%", "%)"), ("•", "●", "▪", "◦")
#: How much deeper an indent has to be, and how many amounts an unnamed total needs.
SAME_INDENT, UNNAMED_AMOUNTS = 0.5, 2


def numeric(text: Column) -> Column:
    """A number or a dash."""
    return text.rlike(NUMERIC) | text.rlike(DASHES)


def real_number(text: Column) -> Column:
    return text.rlike(NUMERIC) & ~text.rlike(BARE_YEAR) & ~text.rlike(DASHES)


def amount(text: Column) -> Column:
    """struct(value, unit): a printed amount and the unit of its last digit; parentheses are negative; null for anything else."""
    bare = F.regexp_replace(text, r"[$, ]", "")
    digits = F.regexp_replace(bare, r"^[()]+|[()]+$", "")
    value = F.when(digits.rlike(r"^[-+]?(\d{1,26}(\.\d{0,9})?|\.\d{1,9})$"), digits.cast("decimal(36,9)"))
    decimals = F.length(F.regexp_extract(digits, r"\.(\d*)$", 1))
    unit = F.element_at(F.array(*(F.lit(f"1e-{k}").cast("decimal(10,9)") for k in range(10))), decimals + 1)
    signed = F.when(bare.startswith("(") & bare.endswith(")"), -value).otherwise(value)
    return F.when(value.isNotNull(), F.struct(signed.cast("decimal(36,9)").alias("value"), unit.alias("unit")))


def name_words(text: Column) -> Column:
    """The words of a label, a plural `s` of longer ones cut."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def names_group(total: Column, group: Column) -> Column:
    """Whether a total's label, after its first word, begins with the group's words."""
    name = name_words(group)
    return (F.size(name) > 0) & (F.slice(name_words(F.substr(total, F.lit(6))), F.lit(1), F.size(name)) == name)


def is_total(label: Column) -> Column:
    return F.lower(label).startswith("total")


def _joined(at: str, text: str, by: str = " ") -> Column:
    """The texts of a group in order of `at`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, text))), lambda x: x[text]), by)


def label_extent(cells: DataFrame) -> DataFrame:
    """(table, label_end): where the first cell ends in most rows that have a number after a first cell that is none; the least of several."""
    row = Window.partitionBy("table", "row")
    firsts = cells.withColumns({"_place": F.row_number().over(row.orderBy("start")), "_n": F.count_if(real_number(F.col("text"))).over(row)})
    rows = firsts.where((F.col("_place") == 1) & ~numeric(F.col("text")) & (F.col("_n") > 0))
    return mode_low(rows, "table", "end").select("table", F.col("mode").alias("label_end"))


def pieces(cells: DataFrame) -> DataFrame:
    """(table, row, start, end, text, number): cells joined to values; `number` if one is a number or dash but no bare year."""
    row = Window.partitionBy("table", "row").orderBy("start")
    opens, closes = F.col("text").isin(*OPENERS), F.col("text").isin(*CLOSERS)
    begins = F.lag(F.lit(1)).over(row).isNull() | (~closes & ~F.lag(opens).over(row))
    own = cells.withColumns({"_o": opens, "_b": begins.cast("int"), "_main": ~opens & ~closes})
    own = own.withColumn("piece", F.sum("_b").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    number = F.bool_or(F.col("_main") & numeric(F.col("text")) & ~F.col("text").rlike(BARE_YEAR))
    start = F.coalesce(F.min(F.when(~F.col("_o"), F.col("start"))), F.min("start"))
    return own.groupBy("table", "row", "piece").agg(start.alias("from"), F.max("end").alias("to"), _joined("start", "text", "").alias("said"), number.alias("number")).select("table", "row", F.col("from").alias("start"), F.col("to").alias("end"), F.col("said").alias("text"), "number")


def described(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(table, row, label, indent, first, kind, block, units, ...) of each row, from its label cells and pieces.

    kind: units, caption (of the whole table), period, group, header or data. block numbers the headers: one that
    follows data begins a new block, and data rows belong to the last; 0 is no header.
    """
    label = labels.groupBy("table", "row").agg(_joined("start", "text").alias("label"), F.min(F.struct("start", "indent", "text")).alias("x"))
    value = values.groupBy("table", "row").agg(F.bool_or("number").alias("data"), F.min(F.struct("start", "text")).alias("v"))
    rows = label.join(value.hint("merge"), ["table", "row"], "full_outer").select(
        "table", "row", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("x.indent", F.lit(0.0)).alias("indent"), F.coalesce("x.text", "v.text").alias("first"),
        F.when(F.col("data").isNull(), "label").when(F.col("data"), "data").otherwise("header").alias("shape"),
    )
    table = Window.partitionBy("table").orderBy("row")
    before, here = table.rowsBetween(Window.unboundedPreceding, -1), table.rowsBetween(Window.unboundedPreceding, 0)
    may_be_units = (F.col("shape") != "data") & F.col("label").rlike(UNITS)
    rows = rows.withColumn("units_row", may_be_units & (F.count_if(may_be_units).over(here) == 1))
    period = (F.col("shape") == "label") & ~F.col("units_row") & F.col("label").rlike(PERIOD)
    opened = F.coalesce(F.count_if((F.col("shape") != "label") | F.col("period")).over(before), F.lit(0))
    rows = rows.withColumn("period", period).withColumn("opened", opened)
    kind = F.when(F.col("shape") != "label", F.col("shape")).when(F.col("units_row"), "units").when(F.col("period"), "period").when(F.col("opened") == 0, "caption").otherwise("group")
    last = F.last(F.when(F.col("shape") != "label", F.col("shape")), True).over(before)
    begins = (F.col("shape") == "header") & (last.isNull() | (last == "data"))
    rows = rows.withColumn("kind", kind).withColumn("_begins", begins.cast("int"))
    rows = rows.withColumn("block", F.sum("_begins").over(here).cast("int"))
    followed = F.count_if(F.col("shape") == "data").over(table.rowsBetween(1, Window.unboundedFollowing)) > 0
    return rows.select("table", "row", "label", "indent", "first", "kind", "block", "units_row", followed.alias("followed"))


def leaves(header: DataFrame, captions: DataFrame) -> DataFrame:
    """(table, block, leaf from 0, start, end, parts, problem) from header cells (table, block, row, start, end, text) and captions (table, block, caption array).

    A column is a header cell that spans none, with no other such cell below it. What spans several separate
    cells of other rows is part of each of their labels, the widest first; what spans all columns goes to the captions.
    """
    cells = header.withColumn("cell", F.struct("row", "start"))
    spread = cells.withColumn("column", F.explode(F.sequence("start", "end")))
    stack = Window.partitionBy("table", "block", "column").orderBy("row")
    above, below = stack.rowsBetween(Window.unboundedPreceding, -1), stack.rowsBetween(1, Window.unboundedFollowing)
    # Of the cells of other rows that stand over or under a cell: some two are apart if the last begins after the first ends.
    met = spread.withColumns({"_end": F.least(F.min("end").over(above), F.min("end").over(below)), "_start": F.greatest(F.max("start").over(above), F.max("start").over(below))})
    spans = met.groupBy("table", "block", "cell", "row", "start", "end", "text").agg((F.max("_start") > F.min("_end")).alias("_spans"))
    spans = spans.withColumn("spans", F.coalesce("_spans", F.lit(False))).drop("_spans")
    under = spans.where("not spans").withColumn("column", F.explode(F.sequence("start", "end")))
    under = under.withColumn("_lower", F.count(F.lit(1)).over(below)).groupBy("table", "block", "cell", "start", "end").agg(F.max("_lower").alias("_lower"))
    order = Window.partitionBy("table", "block").orderBy("start")
    lowest = under.where("_lower = 0").withColumns({"leaf": F.row_number().over(order) - 1, "clash": F.col("start") <= F.lag("end").over(order)})
    edges = lowest.groupBy("table", "block").agg(F.min("end").alias("_first"), F.max("start").alias("_last"), F.max(F.coalesce("clash", F.lit(False))).alias("clash"))
    wide = (F.col("start") <= F.col("_first")) & (F.col("end") >= F.col("_last")) & F.col("spans")
    placed = spans.join(edges.hint("merge"), ["table", "block"]).withColumn("wide", wide)
    said = placed.where("wide").groupBy("table", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "start", "text"))), lambda x: x["text"]).alias("over"))
    # Each leaf's stack: itself, narrower cells of its columns that lie above it, and what spans it.
    own = lowest.select("table", "block", "leaf", "cell", F.col("start").alias("leaf_start"), F.col("end").alias("leaf_end"), F.explode(F.sequence("start", "end")).alias("column"))
    others = placed.where("not wide").select("table", "block", F.col("cell").alias("other"), F.explode(F.sequence("start", "end")).alias("column"), "row", "text", "spans", (F.col("start") - F.col("end")).alias("narrow"))
    stacked = own.join(others.hint("merge"), ["table", "block", "column"]).where((F.col("other") == F.col("cell")) | F.col("spans") | (F.col("row") < F.col("cell.row")))
    parts = F.transform(F.array_sort(F.collect_set(F.struct("narrow", "row", "other", "text"))), lambda x: x["text"])
    found = stacked.groupBy("table", "block", "leaf", F.col("leaf_start").alias("start"), F.col("leaf_end").alias("end")).agg(parts.alias("parts"))
    none = F.array().cast("array<string>")
    found = found.join(said.hint("merge"), ["table", "block"], "left").join(captions.hint("merge"), ["table", "block"], "left").join(edges.select("table", "block", "clash").hint("merge"), ["table", "block"])
    whole = F.array_distinct(F.concat(F.coalesce("caption", none), F.coalesce("over", none), "parts"))
    return found.select("table", "block", "leaf", "start", "end", whole.alias("parts"), F.when(F.col("clash"), "overlapping column headers").alias("problem"))


def nearest_columns(values: DataFrame, columns: DataFrame) -> DataFrame:
    """Values (table, block, row, start, end, ...) with leaf, distance and problem, from columns (table, block, leaf, start, end).

    The nearest column by interval distance, 0 where they overlap, the leftmost of several; under two columns at
    once is a problem, as is a second value for a column that it does not overlap. The columns of a block
    travel as one array: a value is compared with those of its own header only.
    """
    known = columns.groupBy("table", "block").agg(F.sort_array(F.collect_list(F.struct("start", "end", "leaf"))).alias("_c"))
    own = values.join(known.hint("merge"), ["table", "block"], "left")
    start, end = F.col("start"), F.col("end")
    apart = lambda c: F.when((c["start"] <= end) & (start <= c["end"]), 0).otherwise(F.least(F.abs(c["start"] - end), F.abs(start - c["end"])))
    ranked = F.transform("_c", lambda c: F.struct(apart(c).alias("distance"), c["start"].alias("start"), c["leaf"].alias("leaf")))
    own = own.withColumn("_r", ranked).withColumns({"_best": F.array_min("_r"), "_under": F.size(F.filter("_r", lambda r: r["distance"] == 0))})
    own = own.withColumns({"leaf": F.col("_best.leaf"), "distance": F.col("_best.distance")})
    taken = F.row_number().over(Window.partitionBy("table", "row", "leaf").orderBy("start"))
    own = own.withColumn("_taken", taken)
    problem = F.when(F.col("_under") > 1, "a value under two columns").when((F.col("_taken") > 1) & (F.col("distance") > 0), "two values for one column")
    return own.select(*values.columns, "leaf", "distance", (F.col("_taken") > 1).alias("again"), problem.alias("problem"))


def _adds_up(total: Column, unit: Column, value: Column, count: Column) -> Column:
    """Every addend is rounded to the total's last digit: the sum may be off by half of it for each."""
    return F.coalesce(F.abs(total - value) <= unit / 2 * count, F.lit(False))


def grouped(rows: DataFrame, amounts: DataFrame, most: int = 200) -> DataFrame:
    """Data rows with `grp`, the label of the group that they are in, `period`, and `ends` (total, running or null).

    rows: table, row, kind (group, period, data), label, first, indent; amounts: table, row, key (of the column), value, unit.
    A group runs from its label to the first row that ends it: a total of its own, named `Total` or adding up two
    amounts or more of two rows or more, unless a total that names the group comes later; a running total, which adds up
    all rows since the period and not the group's alone; or a row back at the label's indent when all before it
    lay deeper. The rows after such a row are given back to the group if its own total comes and adds up only with
    them. What a running total adds up depends on the totals before it, so the ends of groups are settled in rounds,
    each written to the shared folder, until none changes: one more than a table has running totals.
    """
    shelf = Shelf(rows.sparkSession)
    table = Window.partitionBy("table").orderBy("row")
    here = table.rowsBetween(Window.unboundedPreceding, 0)
    marks = rows.withColumns({
        "segment": F.sum(F.col("kind").isin("group", "period").cast("int")).over(here), "era": F.sum((F.col("kind") == "period").cast("int")).over(here),
        "_group": F.last(F.when(F.col("kind").isin("group", "period"), F.struct(F.when(F.col("kind") == "group", F.col("label")).alias("label"), "indent")), True).over(here),
        "period": F.last(F.when(F.col("kind") == "period", F.rtrim("label", F.lit(":"))), True).over(here),
    })
    marks = marks.withColumns({"group": F.col("_group.label"), "group_indent": F.col("_group.indent"), "_total": is_total(F.col("first"))})
    # Whether a later row of the table is a total that names the group in force: names of groups are few, so those of totals meet them by table.
    names = marks.where("kind = 'group'").select("table", F.col("label").alias("group")).distinct()
    last_named = marks.where("_total").select("table", F.col("row").alias("_at"), "first").join(names.hint("merge"), "table").where(names_group(F.col("first"), F.col("group"))).groupBy("table", "group").agg(F.max("_at").alias("_named"))
    data = marks.where("kind = 'data'").join(last_named.hint("merge"), ["table", "group"], "left")
    segment = Window.partitionBy("table", "segment").orderBy("row")
    prior = segment.rowsBetween(Window.unboundedPreceding, -1)
    data = data.withColumns({"_rows": F.count(F.lit(1)).over(prior), "_shallow": F.min("indent").over(prior), "_later": F.coalesce(F.col("_named") > F.col("row"), F.lit(False))})
    data = data.select("table", "row", "segment", "era", "period", "label", "group", "indent", "group_indent", "_rows", "_shallow", "_later")
    named = is_total(F.col("label"))
    column = Window.partitionBy("table", "segment", "key").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    facts = data.select("table", "row", "segment", "era", F.col("label").alias("_label")).join(amounts.hint("merge"), ["table", "row"], "left")
    facts = facts.withColumns({"own": F.sum("value").over(column).cast("decimal(38,9)"), "own_n": F.count("value").over(column)})
    facts = shelf.cut(facts, "facts")
    row = facts.groupBy("table", "row").agg(F.count("value").alias("_amounts"), F.bool_and(_adds_up(F.col("value"), F.col("unit"), F.col("own"), F.col("own_n")) | F.col("value").isNull()).alias("_of_group"))
    data = shelf.cut(data.join(row.hint("merge"), ["table", "row"]), "data")
    least = F.when(named, 1).otherwise(UNNAMED_AMOUNTS)
    in_group = F.col("group").isNotNull()
    total = F.when(in_group, ~F.col("_later") & (named | ((F.col("_rows") >= 2) & (F.col("_amounts") >= UNNAMED_AMOUNTS) & F.col("_of_group")))).otherwise(named)
    outdented = in_group & (F.col("label") != "") & (F.col("_shallow") > F.col("group_indent") + SAME_INDENT) & (F.col("indent") <= F.col("group_indent") + SAME_INDENT)
    whole = Window.partitionBy("table", "segment")
    running = F.lit(False)
    ends, state = None, None
    for turn in range(most):
        known = data if ends is None else data.join(ends.select("table", "row", "_running").hint("merge"), ["table", "row"], "left")
        running = F.lit(False) if ends is None else F.coalesce("_running", F.lit(False))
        event = F.when(running, "running").when(total, "total").when(outdented, "outdented")
        found = known.withColumn("_event", F.when(in_group, event))
        found = found.withColumn("_end", F.min(F.when(F.col("_event").isNotNull(), F.struct("row", F.col("_event").alias("event")))).over(whole))
        # After its end a segment has no group, and only named totals are left out of running sums.
        at_end, past = F.col("row") == F.col("_end.row"), F.coalesce(F.col("row") > F.col("_end.row"), ~in_group)
        out = F.when(at_end & (F.col("_end.event") != "outdented"), F.col("_end.event")).when(past & named, "total")
        found = shelf.cut(found.select(*data.columns, F.col("_end.row").alias("end_row"), F.col("_end.event").alias("end_event"), out.alias("ends")), f"ends-{turn}")
        now = tuple(found.agg(F.count("ends"), F.sum(F.xxhash64("table", "row", "ends").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
        # What a row's amounts are against all rows of its era that no total takes out.
        era = Window.partitionBy("table", "era", "key").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        rows_before = Window.partitionBy("table", "era").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        counted = found.withColumn("_all_rows", F.count_if(F.col("ends").isNull()).over(rows_before)).select("table", "row", "ends", "_all_rows")
        sums = facts.join(counted.hint("merge"), ["table", "row"]).withColumns({"_sum": F.sum(F.when(F.col("ends").isNull(), F.col("value"))).over(era).cast("decimal(38,9)"), "_n": F.count(F.when(F.col("ends").isNull(), F.col("value"))).over(era)})
        of_all = F.bool_and(_adds_up(F.col("value"), F.col("unit"), F.col("_sum"), F.col("_n")) | F.col("value").isNull())
        every = sums.groupBy("table", "row").agg(of_all.alias("_of_all"), F.max("_all_rows").alias("_all_rows"))
        tested = data.join(every.hint("merge"), ["table", "row"])
        is_running = in_group & (F.col("_all_rows") > F.col("_rows")) & (F.col("_amounts") >= least) & F.col("_of_all") & ~F.col("_of_group")
        shelf.drop(f"running-{turn - 1}")
        ends = shelf.cut(tested.select("table", "row", is_running.alias("_running")).where("_running"), f"running-{turn}")
        shelf.drop(f"ends-{turn - 1}")
    else:
        raise RuntimeError("the ends of groups did not settle")
    # A total after an outdented row that names the group and adds up with what lies between gives those rows back.
    first_total = F.min(F.when((F.col("end_event") == "outdented") & (F.col("row") >= F.col("end_row")) & (F.col("ends") == "total"), F.struct("row", "label", "_of_group", "_amounts"))).over(whole)
    found = found.withColumn("_back", first_total)
    back = F.coalesce(names_group(F.col("_back.label"), F.col("group")) & F.col("_back._of_group") & (F.col("_back._amounts") >= 1), F.lit(False)) & (F.col("row") <= F.col("_back.row"))
    inside = F.col("end_row").isNull() | (F.col("row") < F.col("end_row")) | ((F.col("row") == F.col("end_row")) & (F.col("end_event") == "total")) | back
    out = shelf.cut(found.select("table", "row", F.when(inside, F.col("group")).alias("grp"), "period", "ends"), "grouped")
    shelf.paths.pop("grouped")
    shelf.clear()
    return out


def column_amounts(values: DataFrame) -> DataFrame:
    """(table, row, key, value, unit) of values (table, row, key, text): percentages only in rows of nothing else, and exactly."""
    rate = F.col("text").endswith("%")
    said = amount(F.col("text"))
    rates_only = F.bool_and(rate | said.isNull()).over(Window.partitionBy("table", "row"))
    read = values.withColumns({"_a": said, "_r": amount(F.regexp_replace("text", "%$", "")), "_only": rates_only})
    zero = F.lit(0).cast("decimal(10,9)")
    value = F.when(F.col("_only") & rate, F.col("_r.value")).otherwise(F.col("_a.value"))
    return read.select("table", "row", "key", value.alias("value"), F.when(F.col("_only") & rate, zero).otherwise(F.col("_a.unit")).alias("unit")).where("value is not null")


def lines(cells: DataFrame) -> DataFrame:
    """(table, at, line, fallback): each table's lines in order, `group > label — column: value | column: value`."""
    shelf = Shelf(cells.sparkSession)
    own = shelf.cut(cells.where("text <> ''"), "cells")
    extent = shelf.cut(label_extent(own), "extent")
    known = own.join(extent.hint("merge"), "table")
    split = F.col("start") > F.col("label_end")
    value_cells = known.where(split)
    values = shelf.cut(pieces(value_cells), "pieces")
    rows = shelf.cut(described(known.where(~split), values), "rows")
    blocks = rows.where("kind = 'header'").select("table", "row", "block")
    heads = shelf.cut(value_cells.join(blocks.hint("merge"), ["table", "row"]).select("table", "block", "row", "start", "end", "text"), "heads")
    # Units: a label row's, else those among the header cells, the uppermost.
    by_row = rows.where("units_row").select("table", F.struct(F.lit(0).alias("k"), "row", F.lit(0).alias("start"), F.col("label").alias("text")).alias("u"))
    by_cell = heads.where(F.col("text").rlike(UNITS)).select("table", F.struct(F.lit(1).alias("k"), "row", "start", "text").alias("u"))
    units = shelf.cut(by_row.union(by_cell).groupBy("table").agg(F.min("u").alias("u")).select("table", F.col("u.text").alias("units")), "units")
    # Captions: of the table, then labels of the block's header rows.
    above = rows.where("kind = 'caption'").groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "label"))), lambda x: x["label"]).alias("above"))
    beside = rows.where("kind = 'header' and label <> '' and not units_row").groupBy("table", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "label"))), lambda x: x["label"]).alias("beside"))
    none = F.array().cast("array<string>")
    captions = rows.select("table", "block").distinct().join(above.hint("merge"), "table", "left").join(beside.hint("merge"), ["table", "block"], "left").select("table", "block", F.concat(F.coalesce("above", none), F.coalesce("beside", none)).alias("caption"))
    columns = shelf.cut(leaves(heads.where(~F.col("text").rlike(UNITS)), captions), "columns")
    data = rows.where("kind = 'data'").select("table", "row", "block")
    placed = nearest_columns(values.join(data.hint("merge"), ["table", "row"]), columns).join(columns.select("table", "block", "leaf", "parts").hint("merge"), ["table", "block", "leaf"], "left")
    placed = placed.join(captions.hint("merge"), ["table", "block"], "left").withColumn("_alone", F.count(F.lit(1)).over(Window.partitionBy("table", "row")))
    column = F.when(F.col("leaf").isNotNull(), F.array_join("parts", " ")).otherwise(F.array_join("caption", " "))
    problem = F.coalesce("problem", F.when(F.col("leaf").isNull() & (F.col("_alone") > 1), "several values in a row without column headers"))
    key = F.concat_ws(":", F.col("block"), F.coalesce("leaf", F.lit(-1)), F.when(F.col("again"), F.col("start")))
    placed = placed.select("table", "row", "block", "start", "text", "leaf", column.alias("column"), problem.alias("problem"), key.alias("key"))
    placed = shelf.cut(placed, "placed")
    groups = grouped(rows.where("kind in ('group', 'period', 'data')"), column_amounts(placed.select("table", "row", "key", "text")))
    groups = shelf.cut(groups, "groups")
    # Values of one column that stand side by side share its label.
    along = Window.partitionBy("table", "row").orderBy("start")
    runs = placed.withColumn("_new", F.coalesce((F.lag("column").over(along) != F.col("column")) | (F.col("column") == ""), F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("_new").over(along)).groupBy("table", "row", "run").agg(F.first("column").alias("column"), _joined("start", "text", " / ").alias("texts"))
    said = runs.withColumn("part", F.when(F.col("column") == "", F.col("texts")).otherwise(F.concat_ws(": ", "column", "texts"))).groupBy("table", "row").agg(_joined("run", "part", " | ").alias("said"))
    path = F.concat_ws(" > ", "period", F.rtrim("grp", F.lit(":")), F.nullif("label", F.lit("")))
    body = rows.where("kind = 'data'").join(said.hint("merge"), ["table", "row"]).join(groups.hint("merge"), ["table", "row"]).select("table", F.col("row").alias("at"), F.when(path == "", F.col("said")).otherwise(F.concat_ws(" — ", path, "said")).alias("line"))
    titles = rows.where("kind in ('group', 'period')").select("table", F.col("row").alias("at"), F.col("label").alias("line"))
    text_row = own.groupBy("table", "row").agg(_text_row().alias("line")).select("table", F.col("row").alias("at"), "line")
    # Header rows that no data row follows are no header.
    loose = rows.where("kind = 'header' and not followed").select("table", F.col("row").alias("at"))
    tail = text_row.join(loose.hint("merge"), ["table", "at"], "left_semi").join(rows.groupBy("table").agg(F.max("row").alias("_last")).hint("merge"), "table").select("table", (F.col("at") + F.col("_last") + 1).alias("at"), "line")
    opening = units.select("table", F.lit(-1).alias("at"), F.col("units").alias("line"))
    read = opening.union(body).union(titles).union(tail)
    # A header's text that no value's column says would be lost, as would a caption without values.
    told = placed.select("table", "block", "leaf").distinct().join(columns.hint("merge"), ["table", "block", "leaf"]).select("table", F.explode("parts").alias("text"))
    told = told.union(placed.where("leaf is null").join(captions.hint("merge"), ["table", "block"]).select("table", F.explode("caption").alias("text"))).union(units.select("table", F.col("units").alias("text"))).distinct()
    shown = rows.where("kind = 'header' and followed").select("table", "row")
    must = heads.join(shown.hint("merge"), ["table", "row"], "left_semi").select("table", "text").union(rows.where("kind = 'caption' or (kind = 'header' and followed and label <> '')").select("table", F.col("label").alias("text")))
    lost = must.join(told.hint("merge"), ["table", "text"], "left_anti").select("table", F.concat(F.lit("lost: "), F.substring("text", 1, 60)).alias("problem"))
    problems = placed.select("table", "problem").union(columns.select("table", "problem")).where("problem is not null").union(lost).groupBy("table").agg(F.min("problem").alias("fallback"))
    problems = shelf.cut(problems, "problems")
    good = read.join(problems.hint("merge"), "table", "left_anti").select("table", "at", "line", F.lit(None).cast("string").alias("fallback"))
    plain = text_row.join(problems.hint("merge"), "table").select("table", "at", "line", "fallback")
    no_values = text_row.join(extent.hint("merge"), "table", "left_anti").select("table", "at", "line", F.lit("no row of values").alias("fallback"))
    out = shelf.cut(good.union(plain).union(no_values), "lines")
    shelf.paths.pop("lines")
    shelf.clear()
    return out


def _text_row() -> Column:
    """A row's cells joined by bars; a bullet of its own joins its text with a space."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
    bullet = (F.size(texts) > 1) & F.try_element_at(texts, F.lit(1)).isin(*BULLETS)
    return F.when(bullet, F.concat_ws(" ", F.try_element_at(texts, F.lit(1)), F.array_join(F.slice(texts, F.lit(2), F.size(texts)), " | "))).otherwise(F.array_join(texts, " | "))
