"""Registered queries over tables of cells. Each supplier's lines, added up by flag and line number, are a printed table
with groups, totals that are named or not, misprints, subtotals, running totals, periods and rows at a label's indent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import cells as C
from ledgerloom.plans.registry import query
from ledgerloom.storage import cut, table

# Row places: 100 a flag; its label at 0, line k at 10 k, a subtotal at 45, the total at 90, all lines so far at 95.
_LINES = """l AS (SELECT l_suppkey AS tab, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS f, l_linenumber AS k,
  sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT tab, f, sum(cents) AS cents, sum(n) AS n, sum(CASE WHEN k <= 4 THEN cents END) AS half_cents, sum(CASE WHEN k <= 4 THEN n END) AS half_n FROM l GROUP BY 1, 2),
a AS (SELECT x.tab, x.f, sum(y.cents) AS cents, sum(y.n) AS n FROM s x JOIN s y ON x.tab = y.tab AND y.f <= x.f GROUP BY 1, 2),
r AS (
  SELECT tab, f * 100 + 1 AS place, 'group' AS kind, 'Flag ' || f || ':' AS label, 0 AS indent, NULL AS cents, NULL AS n FROM s
  UNION ALL SELECT tab, 100, 'period', 'June 30, 2025', 0, NULL, NULL FROM s WHERE f = 1 AND tab % 6 = 2
  UNION ALL SELECT tab, f * 100 + 10 * k, 'data', 'Line ' || k, CASE WHEN tab % 4 = 0 AND k >= 6 THEN 0 ELSE 10 END, cents, n FROM l
  UNION ALL SELECT tab, f * 100 + 45, 'data', 'Lines one to four', 10, half_cents, half_n FROM s WHERE tab % 7 = 0 AND half_n IS NOT NULL
  UNION ALL SELECT tab, f * 100 + 90, 'data', CASE (tab + f) % 3 WHEN 0 THEN 'Total flag ' || f ELSE 'Net of ' || f END, CASE WHEN tab % 4 = 0 THEN 0 ELSE 10 END, cents + CASE WHEN f = 1 AND tab % 5 = 0 THEN 900000000 ELSE 0 END, n FROM s WHERE (tab + f) % 3 < 2 AND tab % 8 <> 3
  UNION ALL SELECT tab, f * 100 + 95, 'data', 'All lines', 10, cents, n FROM a WHERE f > 0 AND tab % 2 = 1),
printed AS (SELECT tab, place, kind, label, indent, CAST((cents + 50000) // 100000 AS BIGINT) AS q, CAST(n AS BIGINT) AS n FROM r)"""


def _printed(spark: SparkSession, d: str) -> DataFrame:
    """(tab, at, kind, label, indent, q, n): q in thousands, rounded."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("tab"), flag.alias("f"), F.col("l_linenumber").alias("k")).agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("n"))
    lines = cut(lines, "lines")  # all rows of the tables come from these sums
    half = lambda c: F.sum(F.when(F.col("k") <= 4, F.col(c))).alias(f"half_{c}")
    sums = lines.groupBy("tab", "f").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"), half("cents"), half("n"))
    so_far = sums.select("tab", F.explode(F.sequence("f", F.lit(2))).alias("f"), "cents", "n").groupBy("tab", "f").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n")).join(sums.select("tab", "f").hint("merge"), ["tab", "f"], "left_semi")
    place = F.col("f") * 100
    none = F.lit(None).cast("long")
    put = lambda df, at, kind, label, indent, q, n: df.select("tab", at.cast("int").alias("place"), F.lit(kind).alias("kind"), label.alias("label"), indent.alias("indent"), q.alias("cents"), n.alias("n"))
    said = lambda *x: F.concat(*(F.lit(c) if isinstance(c, str) else c for c in x))
    f, k, tab = F.col("f").cast("string"), F.col("k").cast("string"), F.col("tab")
    rows = [
        put(sums, place + 1, "group", said("Flag ", f, ":"), F.lit(0), none, none),
        put(sums.where((F.col("f") == 1) & (tab % 6 == 2)), F.lit(100), "period", F.lit("June 30, 2025"), F.lit(0), none, none),
        put(lines, place + 10 * F.col("k"), "data", said("Line ", k), F.when((tab % 4 == 0) & (F.col("k") >= 6), 0).otherwise(10), F.col("cents"), F.col("n")),
        put(sums.where((tab % 7 == 0) & F.col("half_n").isNotNull()), place + 45, "data", F.lit("Lines one to four"), F.lit(10), F.col("half_cents"), F.col("half_n")),
        put(
            sums.where(((tab + F.col("f")) % 3 < 2) & (tab % 8 != 3)), place + 90, "data", F.when((tab + F.col("f")) % 3 == 0, said("Total flag ", f)).otherwise(said("Net of ", f)), F.when(tab % 4 == 0, 0).otherwise(10),
            F.col("cents") + F.when((F.col("f") == 1) & (tab % 5 == 0), 900000000).otherwise(0), F.col("n"),
        ),
        put(so_far.where((F.col("f") > 0) & (tab % 2 == 1)), place + 95, "data", F.lit("All lines"), F.lit(10), F.col("cents"), F.col("n")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return cut(out.select("tab", "place", "kind", "label", "indent", F.floor((F.col("cents") + 50000) / 100000).alias("q"), "n"), "printed")


#: Walks every table row by row, with the state that a reader would keep.
_WALKED = f"""WITH RECURSIVE {_LINES},
i AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY place) AS i, label LIKE 'Total%' AS named FROM printed),
later AS (SELECT tab, 'Flag ' || substr(label, 12) || ':' AS grp, max(i) AS last FROM i WHERE named GROUP BY 1, 2),
walk AS (
  SELECT DISTINCT tab, CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS place, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS q, CAST(NULL AS BIGINT) AS n,
    CAST(NULL AS VARCHAR) AS grp, 0 AS ind, CAST(0 AS HUGEINT) AS gq, CAST(0 AS HUGEINT) AS gn, 0 AS gc, CAST(NULL AS INTEGER) AS shallow, CAST(0 AS HUGEINT) AS rq, CAST(0 AS HUGEINT) AS rn, 0 AS rc,
    CAST(NULL AS VARCHAR) AS held, CAST(NULL AS INTEGER) AS held_from, CAST(NULL AS VARCHAR) AS period, CAST(NULL AS VARCHAR) AS own, CAST(NULL AS VARCHAR) AS ends, CAST(NULL AS VARCHAR) AS back, CAST(NULL AS INTEGER) AS back_from FROM i
  UNION ALL
  SELECT tab, i, place, kind, label, q, n,
    CASE WHEN kind = 'group' THEN label WHEN kind = 'period' OR total OR running OR outdented THEN NULL ELSE grp END,
    CASE WHEN kind = 'group' THEN indent ELSE ind END,
    CASE WHEN kind = 'group' THEN 0 WHEN counted THEN gq + q ELSE gq END, CASE WHEN kind = 'group' THEN 0 WHEN counted THEN gn + n ELSE gn END, CASE WHEN kind = 'group' THEN 0 WHEN counted THEN gc + 1 ELSE gc END,
    CASE WHEN kind = 'group' THEN NULL WHEN counted THEN least(coalesce(shallow, indent), indent) ELSE shallow END,
    CASE WHEN kind = 'period' THEN 0 WHEN counted THEN rq + q ELSE rq END, CASE WHEN kind = 'period' THEN 0 WHEN counted THEN rn + n ELSE rn END, CASE WHEN kind = 'period' THEN 0 WHEN counted THEN rc + 1 ELSE rc END,
    CASE WHEN kind <> 'data' OR total OR running THEN NULL WHEN outdented THEN grp ELSE held END, CASE WHEN outdented THEN place ELSE held_from END,
    CASE WHEN kind = 'period' THEN label ELSE period END,
    CASE WHEN running OR outdented THEN NULL WHEN back THEN held ELSE grp END, CASE WHEN running THEN 'running' WHEN total THEN 'total' END, CASE WHEN back THEN held END, CASE WHEN back THEN held_from END
  FROM (SELECT *, kind = 'data' AND NOT total AND NOT running AS counted, total AND NOT running AND held IS NOT NULL AND label = 'Total flag ' || rtrim(substr(held, 6), ':') AND of_group AS back,
      NOT running AND NOT total AND grp IS NOT NULL AND kind = 'data' AND coalesce(shallow > ind, FALSE) AND indent <= ind AS outdented
    FROM (SELECT *, kind = 'data' AND NOT later AND (named OR (grp IS NOT NULL AND gc >= 2 AND of_group)) AS total, kind = 'data' AND grp IS NOT NULL AND rc > gc AND of_all AND NOT of_group AS running
      FROM (SELECT w.* EXCLUDE (i, place, kind, label, q, n, own, ends, back, back_from), r.i, r.place, r.kind, r.label, r.q, r.n, r.indent, r.named, coalesce(t.last > r.i, FALSE) AS later,
          coalesce(w.gc > 0 AND abs(w.gq - r.q) * 2 <= w.gc AND abs(w.gn - r.n) * 2 <= w.gc, FALSE) AS of_group, coalesce(w.rc > 0 AND abs(w.rq - r.q) * 2 <= w.rc AND abs(w.rn - r.n) * 2 <= w.rc, FALSE) AS of_all
        FROM walk w JOIN i r ON r.tab = w.tab AND r.i = w.i + 1 LEFT JOIN later t ON t.tab = w.tab AND t.grp = w.grp)))),
b AS (SELECT tab, back, back_from, place FROM walk WHERE back IS NOT NULL),
done AS (SELECT w.tab, w.place, w.kind, w.label, w.q, w.n, coalesce(b.back, w.own) AS grp, rtrim(w.period, ':') AS period, w.ends FROM walk w LEFT JOIN b ON b.tab = w.tab AND w.place BETWEEN b.back_from AND b.place WHERE w.i > 0)"""


@query("table_totals", f"{_WALKED} SELECT tab, place, grp, period, ends FROM done WHERE kind = 'data'")
def table_totals(spark: SparkSession, d: str) -> DataFrame:
    """The group of every row of every supplier's table, and the totals that end groups."""
    rows = _printed(spark, d).select(F.col("tab").alias("table"), F.col("place").alias("row"), "kind", "label", F.col("label").alias("first"), F.col("indent").cast("double").alias("indent"), "q", "n")
    cells = rows.where("kind = 'data'").select("table", "row", F.explode(F.map_from_arrays(F.array(F.lit("q"), F.lit("n")), F.array("q", "n"))).alias("key", "v"))
    amounts = C.column_amounts(cells.select("table", "row", "key", F.format_number("v", 0).alias("text")))
    return C.grouped(rows.drop("q", "n"), amounts).select(F.col("table").alias("tab"), F.col("row").alias("place"), "grp", "period", "ends")


@query("table_lines", f"""{_WALKED}, line AS (
  SELECT tab, place, CASE WHEN kind <> 'data' THEN label ELSE concat_ws(' > ', period, rtrim(grp, ':'), label) || ' — Amount: ' || CASE WHEN q > 999 THEN format('{{:,}}', q) ELSE q::VARCHAR END || ' | Lines: ' || CASE WHEN n > 999 THEN format('{{:,}}', n) ELSE n::VARCHAR END END AS line FROM done
  UNION ALL SELECT DISTINCT tab, -1, '(in thousands)' FROM printed)
SELECT tab, place, line FROM line""")
def table_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's table as cells, its currency sign in a cell of its own and its units among the headers, and the labelled lines read from them."""
    rows = _printed(spark, d)
    head = rows.select("tab").distinct()
    cell = lambda df, row, start, end, text, indent=None: df.select(F.col("tab").alias("table"), row.alias("row"), F.lit(start).alias("start"), F.lit(end).alias("end"), text.alias("text"), (F.lit(0.0) if indent is None else indent.cast("double")).alias("indent"))
    data = rows.where("kind = 'data'")
    parts = [
        cell(head, F.lit(-2), 1, 3, F.lit("Amount")), cell(head, F.lit(-2), 4, 4, F.lit("Lines")), cell(head, F.lit(-1), 1, 4, F.lit("(in thousands)")),
        cell(rows, F.col("place"), 0, 0, F.col("label"), F.col("indent")), cell(data, F.col("place"), 1, 1, F.lit("$")), cell(data, F.col("place"), 2, 3, F.format_number("q", 0)), cell(data, F.col("place"), 4, 4, F.format_number("n", 0)),
    ]
    cells = parts[0]
    for more in parts[1:]:
        cells = cells.unionByName(more)
    return C.lines(cells).select(F.col("table").alias("tab"), F.col("at").alias("place"), F.regexp_replace("line", r"\$", "").alias("line"))


_COLUMNS = """v AS (SELECT l_orderkey AS tab, 1 + CAST(l_linenumber > 4 AS INTEGER) AS block, l_linenumber AS row, CAST(l_quantity AS INTEGER) % 47 AS a, max(CAST(l_quantity AS INTEGER) % 47 + l_suppkey % 9) AS b FROM lineitem GROUP BY ALL),
c AS (SELECT tab, block, leaf, leaf * 10 + tab % 3 + 5 * (block - 1) AS a, leaf * 10 + tab % 3 + 5 * (block - 1) + (tab + leaf) % 5 AS b FROM (SELECT DISTINCT tab, block FROM v), range(4) AS r(leaf))"""


@query("nearest_columns", f"""WITH {_COLUMNS},
d AS (SELECT v.tab, v.block, v.row, v.a, c.leaf, c.a AS from_, CASE WHEN c.a <= v.b AND v.a <= c.b THEN 0 ELSE least(abs(c.a - v.b), abs(v.a - c.b)) END AS distance FROM v JOIN c ON v.tab = c.tab AND v.block = c.block),
n AS (SELECT *, row_number() OVER (PARTITION BY tab, row, a ORDER BY distance, from_) AS r, count(*) FILTER (distance = 0) OVER (PARTITION BY tab, row, a) AS under FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY tab, row, leaf ORDER BY a) AS taken FROM n WHERE r = 1)
SELECT tab, row, CAST(a AS INTEGER) AS start, CAST(leaf AS INTEGER) AS leaf, CAST(distance AS INTEGER) AS distance, CASE WHEN under > 1 THEN 'a value under two columns' WHEN taken > 1 AND distance > 0 THEN 'two values for one column' END AS problem FROM t""")
def nearest_columns(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as values, four columns to each of two header blocks; the columns of the second stand elsewhere."""
    at = F.col("l_quantity").cast("int") % 47
    items = table(spark, d, "lineitem")
    values = items.groupBy(F.col("l_orderkey").alias("table"), (1 + (F.col("l_linenumber") > 4).cast("int")).alias("block"), F.col("l_linenumber").alias("row"), at.alias("start")).agg(F.max(at + F.col("l_suppkey") % 9).cast("int").alias("end"))
    leaf = F.explode(F.sequence(F.lit(0), F.lit(3)))
    columns = values.select("table", "block").distinct().withColumn("leaf", leaf)
    start = (F.col("leaf") * 10 + F.col("table") % 3 + 5 * (F.col("block") - 1)).cast("int")
    columns = columns.select("table", "block", "leaf", start.alias("start"), (start + (F.col("table") + F.col("leaf")) % 5).cast("int").alias("end"))
    return C.nearest_columns(values, columns).select(F.col("table").alias("tab"), "row", "start", "leaf", "distance", "problem")
