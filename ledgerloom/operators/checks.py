"""Checks of what was read against what a filer's own facts and taxonomy say, and of runs against each other.

`column_alignment`: whether the values of each column share an aspect of their facts. `ancestors` and
`group_disagreements`: whether rows that the layout puts into one group hang together in the presentation tree.
`in_every_execution`, `variation_counts`, `pairs_alike`: runs compared on the questions that all of them answered.
`regraded` and `only` are gates: they stop the job at the first row that may not be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.evaluation import variation
from ledgerloom.storage import Shelf

ASPECTS = ("period", "dims", "concept", "unit")


def column_alignment(values: DataFrame) -> DataFrame:
    """(table, column, n, aspect, key, status) from tagged values (table, column, start, end, instant, dims, concept, unit).

    The aspect of a table is the one, or pair of them, with the most distinct values that are constant within
    columns; of several the one that covers more columns, then a single one, then the first. A column without a constant value of it is
    `misaligned`, two with the same are `indistinct`, others `aligned`. Columns of one value are `not checkable`,
    and so are all of a table with less than two others (aspect null). A period is constant if there is one
    duration, with instants only at its end or the day before its start, or one instant alone.
    """
    duration = F.when(F.col("instant").isNull(), F.struct("start", "end"))
    one = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    columns = values.groupBy("table", "column").agg(
        F.count(F.lit(1)).alias("n"), F.min(duration).alias("_low"), F.max(duration).alias("_high"), F.min("instant").alias("_first"), F.max("instant").alias("_last"),
        F.count_distinct("instant").alias("_instants"), *(one(F.coalesce(c, F.lit(""))).alias(c) for c in ASPECTS[1:]),
    )
    edges = F.array(F.col("_low.end"), F.date_sub("_low.start", 1))
    within = F.col("_first").isNull() | ((F.col("_instants") <= 2) & F.array_contains(edges, F.col("_first")) & F.array_contains(edges, F.col("_last")))
    lasting = F.when((F.col("_low") == F.col("_high")) & within, F.concat_ws("/", "_low.start", "_low.end"))
    period = F.when(F.col("_low").isNotNull(), lasting).when(F.col("_instants") == 1, F.col("_first").cast("string"))
    columns = columns.withColumn("period", period)
    many = F.count_if(F.col("n") >= 2).over(Window.partitionBy("table"))
    columns = columns.withColumn("_checked", (F.col("n") >= 2) & (many >= 2))
    pairs = [(a, b) for k, a in enumerate(ASPECTS) for b in ASPECTS[k + 1 :]]
    options = [(a, F.col(a)) for a in ASPECTS] + [(f"{a}+{b}", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat(a, F.lit("\x00"), b))) for a, b in pairs]
    spread = columns.where("_checked").select("table", "column", F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(name).alias("aspect"), key.alias("key")) for k, (name, key) in enumerate(options)))).alias("o")).select("table", "column", "o.*")
    rank = F.struct((-F.count_distinct("key")).alias("a"), (-F.count("key")).alias("b"), F.min("place").alias("c"))
    best = spread.groupBy("table", "aspect").agg(rank.alias("rank")).groupBy("table").agg(F.min_by("aspect", "rank").alias("aspect"))
    chosen = spread.join(best, ["table", "aspect"]).withColumn("_same", F.count("key").over(Window.partitionBy("table", "key")))
    status = F.when(F.col("aspect").isNull(), "not checkable").when(F.col("key").isNull(), "misaligned").when(F.col("_same") > 1, "indistinct").otherwise("aligned")
    return columns.select("table", "column", "n").join(chosen.select("table", "column", "aspect", "key", "_same"), ["table", "column"], "left").select("table", "column", "n", "aspect", "key", status.alias("status"))


def ancestors(parents: DataFrame, most: int = 32) -> DataFrame:
    """(role, node, ancestor) of parents (role, child, parent): paths double their length each round, which is written to the shared folder.

    A node on a circle is its own ancestor; the rounds are as many as the logarithm of the deepest path.
    """
    shelf = Shelf(parents.sparkSession)
    now = shelf.cut(parents.select("role", F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node is not null and ancestor is not null").distinct(), "paths-0")
    count = now.count()
    for turn in range(1, most + 1):
        onward = now.select("role", F.col("node").alias("ancestor"), F.col("ancestor").alias("above"))
        longer = now.join(onward, ["role", "ancestor"]).select("role", "node", F.col("above").alias("ancestor"))
        now = shelf.cut(now.union(longer).distinct(), f"paths-{turn}")
        shelf.drop(f"paths-{turn - 1}")
        before, count = count, now.count()
        if count == before:
            return now
    raise RuntimeError("the tree is too deep")


def group_disagreements(rows: DataFrame, parents: DataFrame) -> DataFrame:
    """(table, row, grp, parent, shared, kind) where groups of rows (table, row, label, grp, concept) and the tree of parents (role, child, parent) disagree.

    The role with the most of a table's concepts is its own. The node that more than half of a run's rows hang
    under is the group's, unless it is a [Line Items] node or rows before the group share it. `inside`: a row of the group hangs elsewhere,
    neither above nor below that node. `outside`: a row right after the group, in none, hangs under it. Totals do not
    count; tables with fewer than two known concepts, or one concept in two groups, are skipped.
    """
    shelf = Shelf(rows.sparkSession)
    tagged = rows.where("concept is not null")
    met = tagged.join(parents.select("role", F.col("child").alias("concept")).distinct(), "concept").groupBy("table", "role").agg(F.count(F.lit(1)).alias("n"))
    role = met.groupBy("table").agg(F.min(F.struct((-F.col("n")).alias("n"), "role")).alias("b")).where("b.n <= -2").select("table", "b.role")
    twofold = tagged.where("grp is not null").groupBy("table", "concept").agg(F.count_distinct("grp").alias("n")).where("n > 1").select("table").distinct()
    own = tagged.join(role, "table").join(twofold, "table", "left_anti").join(parents.select("role", F.col("child").alias("concept"), "parent"), ["role", "concept"], "left")
    order = Window.partitionBy("table").orderBy("row")
    begins = F.lag(F.lit(1)).over(order).isNull() | ~F.lag("grp").over(order).eqNullSafe(F.col("grp"))
    own = own.withColumn("_b", begins.cast("int")).withColumn("run", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
    own = shelf.cut(own.withColumn("total", F.lower(F.coalesce("label", F.lit(""))).startswith("total")), "runs")
    counts = own.where("parent is not null").groupBy("table", "run", "parent").agg(F.count(F.lit(1)).alias("n"))
    whole = F.sum("n").over(Window.partitionBy("table", "run"))
    shared = counts.withColumn("_all", whole).where("_all >= 2 and 2 * n > _all").select("table", "run", F.col("parent").alias("shared"))
    grouped = own.groupBy("table", "run").agg(F.min("row").alias("_from"), F.first("grp").alias("_grp"), F.min("role").alias("role")).where("_grp is not null")
    nodes = grouped.join(shared, ["table", "run"]).where(~F.col("shared").endswith("LineItems"))
    loose = own.where("grp is null and parent is not null").groupBy("table", F.col("parent").alias("shared")).agg(F.min("row").alias("_loose"))
    nodes = shelf.cut(nodes.join(loose, ["table", "shared"], "left").where("_loose is null or _loose > _from").select("table", "run", "role", F.col("_grp").alias("of"), "shared"), "nodes")
    up = ancestors(parents)
    inside = own.join(nodes.drop("role"), ["table", "run"]).where("parent is not null and parent <> shared and not total")
    for low, high in (("parent", "shared"), ("shared", "parent")):
        inside = inside.join(up.select("role", F.col("node").alias(low), F.col("ancestor").alias(high)), ["role", low, high], "left_anti")
    after = nodes.withColumn("run", F.col("run") + 1)
    outside = own.join(after.drop("role"), ["table", "run"]).where("grp is null and parent = shared and not total")
    named = lambda df, kind: df.select("table", "row", F.col("of").alias("grp"), "parent", "shared", F.lit(kind).alias("kind"))
    out = shelf.cut(named(inside, "inside").union(named(outside, "outside")), "disagreements")
    shelf.paths.pop("disagreements")
    shelf.clear()
    return out


def in_every_execution(answers: DataFrame, executions: list[str] | None = None) -> DataFrame:
    """The answers (scenario, execution, ...) of scenarios that every execution has; one row of each, the first by all columns."""
    own = answers if executions is None else answers.where(F.col("execution").isin(list(executions)))
    rest = [c for c in own.columns if c not in ("scenario", "execution")]
    own = own.groupBy("scenario", "execution").agg(F.min(F.struct(*rest)).alias("x")).select("scenario", "execution", *(F.col(f"x.{c}").alias(c) for c in rest))
    # A list that is given is as long as it is, so that an execution without answers leaves nothing.
    wanted = own.agg(F.count_distinct("execution").alias("wanted")) if executions is None else own.sparkSession.range(1).select(F.lit(len(set(executions))).cast("long").alias("wanted"))
    have = own.groupBy("scenario").agg(F.count(F.lit(1)).alias("have"))
    whole = have.join(F.broadcast(wanted), F.col("have") == F.col("wanted")).select("scenario")  # `wanted` is one row
    return own.join(whole, "scenario", "left_semi")


def variation_counts(answers: DataFrame, qset: Column) -> DataFrame:
    """(qset, n, identical, wording, figures, grade) of aligned answers (scenario, execution, text, figures, grade), and over all sets in the row `All`."""
    kinds = variation(answers).withColumn("qset", qset)
    counts = [F.count_if(F.col("variation") == k).alias(k.lower()) for k in ("Identical", "Wording", "Figures", "Grade")]
    return kinds.rollup("qset").agg(F.grouping("qset").alias("_all"), F.count(F.lit(1)).alias("n"), *counts).withColumn("qset", F.when(F.col("_all") == 1, "All").otherwise(F.col("qset"))).drop("_all")


def pairs_alike(answers: DataFrame) -> DataFrame:
    """(left_run, right_run, n, same_text, graded, same_grade) of each pair of executions over aligned answers; the grade "-" is none."""
    said = F.translate("text", "’", "'")
    a = answers.select("scenario", F.col("execution").alias("left_run"), said.alias("lt"), F.col("grade").alias("lg"))
    b = answers.select("scenario", F.col("execution").alias("right_run"), said.alias("rt"), F.col("grade").alias("rg"))
    both = a.join(b, "scenario").where("left_run < right_run")
    graded = (F.col("lg") != "-") & (F.col("rg") != "-")
    return both.groupBy("left_run", "right_run").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lt") == F.col("rt")).alias("same_text"), F.count_if(graded).alias("graded"), F.count_if(graded & (F.col("lg") == F.col("rg"))).alias("same_grade"))


def regraded(stored: DataFrame, now: DataFrame, by: list[str]) -> DataFrame:
    """The stored rows (by, grade), if each is graded now as it was then; a row that differs, or is not graded any more, stops the job."""
    both = stored.join(now.select(*by, F.col("status").alias("_now")), by, "left")
    wrong = F.concat(F.lit("graded "), F.coalesce("_now", F.lit("nothing")), F.lit(" on import, "), F.coalesce("grade", F.lit("nothing")), F.lit(" when it ran: "), F.concat_ws(".", *by))
    return both.withColumn("grade", F.when(F.col("_now").eqNullSafe(F.col("grade")), F.col("grade")).otherwise(F.raise_error(wrong))).drop("_now")


def only(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """The questions with an id of `ids` (id); an id that no question has stops the job."""
    known = ids.select("id").distinct().join(questions.select("id").distinct().withColumn("_known", F.lit(True)), "id", "left")
    checked = known.select(F.when(F.col("_known"), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("unknown id "), F.col("id").cast("string")))).alias("id"))
    return questions.join(checked, "id", "left_semi")
