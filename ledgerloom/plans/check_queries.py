"""Registered queries over checks: lines of orders as tagged values and rows, events as answers of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import checks as K
from ledgerloom.plans.registry import query
from ledgerloom.storage import table


@query("column_alignment", """WITH v AS (SELECT l_suppkey % 400 AS tab, l_linenumber % 4 AS col, l_suppkey % 5 AS s, l_partkey % 97 AS odd, l_linenumber AS k FROM lineitem),
f AS (SELECT tab, col, CASE WHEN s = 3 AND odd = 5 THEN 2040 WHEN s = 2 THEN 2030 ELSE 2030 + col END AS y, CASE WHEN s < 2 THEN odd % 3 ELSE 0 END AS at_, CASE WHEN s = 4 THEN 'd' || (col // 2) ELSE '' END AS dims, CASE WHEN s = 2 THEN 'c' || col WHEN s = 4 THEN 'c' || (col % 2) ELSE 'c' || odd END AS concept FROM v),
p AS (SELECT *, CASE at_ WHEN 0 THEN make_date(y, 1, 1) END AS a, CASE at_ WHEN 0 THEN make_date(y, 12, 31) END AS b, CASE at_ WHEN 1 THEN make_date(y, 12, 31) WHEN 2 THEN make_date(y - 1, 12, 31) END AS i FROM f),
c AS (SELECT tab, col, count(*) AS n, list(DISTINCT a::VARCHAR || '/' || b::VARCHAR) FILTER (i IS NULL) AS ds, list(DISTINCT i) FILTER (i IS NOT NULL) AS ins, CASE WHEN count(DISTINCT dims) = 1 THEN any_value(dims) END AS dims, CASE WHEN count(DISTINCT concept) = 1 THEN any_value(concept) END AS concept, 'USD' AS unit FROM p GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN len(ds) = 1 THEN CASE WHEN ins IS NULL OR len(list_filter(ins, lambda x: x <> ds[1][12:]::DATE AND x <> ds[1][:10]::DATE - 1)) = 0 THEN ds[1] END WHEN ds IS NULL AND len(ins) = 1 THEN ins[1]::VARCHAR END AS period, n >= 2 AND count(*) FILTER (n >= 2) OVER (PARTITION BY tab) >= 2 AS checked FROM c),
o AS (SELECT tab, col, unnest([{'place': 0, 'aspect': 'period', 'key': period}, {'place': 1, 'aspect': 'dims', 'key': dims}, {'place': 2, 'aspect': 'concept', 'key': concept}, {'place': 3, 'aspect': 'unit', 'key': unit}, {'place': 4, 'aspect': 'period+dims', 'key': period || '!' || dims},
  {'place': 5, 'aspect': 'period+concept', 'key': period || '!' || concept}, {'place': 6, 'aspect': 'period+unit', 'key': period || '!' || unit}, {'place': 7, 'aspect': 'dims+concept', 'key': dims || '!' || concept}, {'place': 8, 'aspect': 'dims+unit', 'key': dims || '!' || unit}, {'place': 9, 'aspect': 'concept+unit', 'key': concept || '!' || unit}], recursive := true) FROM q WHERE checked),
r AS (SELECT tab, aspect, row_number() OVER (PARTITION BY tab ORDER BY count(DISTINCT key) DESC, count(key) DESC, min(place)) AS r FROM o GROUP BY tab, aspect),
x AS (SELECT o.tab, o.col, o.aspect, o.key, count(o.key) OVER (PARTITION BY o.tab, o.key) AS same FROM o JOIN r ON r.tab = o.tab AND r.aspect = o.aspect AND r.r = 1)
SELECT q.tab, q.col, q.n, x.aspect, CASE WHEN x.aspect IS NULL THEN 'not checkable' WHEN x.key IS NULL THEN 'misaligned' WHEN same > 1 THEN 'indistinct' ELSE 'aligned' END AS status FROM q LEFT JOIN x ON x.tab = q.tab AND x.col = q.col""")
def column_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as tables of four columns: of years with opening and closing instants, of concepts, of years with strays, of members and concepts."""
    kind, odd, column = F.col("l_suppkey") % 5, F.col("l_partkey") % 97, F.col("l_linenumber") % 4
    year = F.when((kind == 3) & (odd == 5), 2040).when(kind == 2, 2030).otherwise(2030 + column)
    at = F.when(kind < 2, odd % 3).otherwise(0)
    day = lambda y, m, dd: F.make_date(y, F.lit(m), F.lit(dd))
    text = lambda before, c: F.concat(F.lit(before), c.cast("string"))
    dims = F.when(kind == 4, text("d", F.floor(column / 2))).otherwise("")
    concept = F.when(kind == 2, text("c", column)).when(kind == 4, text("c", column % 2)).otherwise(text("c", odd))
    values = table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 400).alias("table"), column.alias("column"), F.when(at == 0, day(year, 1, 1)).alias("start"), F.when(at == 0, day(year, 12, 31)).alias("end"),
        F.when(at == 1, day(year, 12, 31)).when(at == 2, day(year - 1, 12, 31)).alias("instant"), dims.alias("dims"), concept.alias("concept"), F.lit("USD").alias("unit"),
    )
    return K.column_alignment(values).select(F.col("table").alias("tab"), F.col("column").alias("col"), "n", "aspect", "status")


@query("group_disagreements", """WITH RECURSIVE par AS (SELECT role, k AS child, k // 2 AS parent FROM (SELECT DISTINCT p_partkey % 14 + 1 AS k FROM part), (VALUES (0), (1)) AS r(role) WHERE k > 1 AND (role = 0 OR k % 3 > 0)),
anc AS (SELECT role, child, parent AS anc FROM par UNION SELECT a.role, a.child, p.parent FROM anc a JOIN par p ON p.role = a.role AND p.child = a.anc),
t AS (SELECT l_orderkey AS tab, l_linenumber AS row_, max(l_partkey) % 14 + 1 AS concept, arg_max(CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'N' END, l_partkey) AS grp FROM lineitem GROUP BY 1, 2),
m AS (SELECT tab, role, count(*) AS n FROM t JOIN par ON child = concept GROUP BY 1, 2), o AS (SELECT tab, role FROM (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY n DESC, role) AS k FROM m) WHERE k = 1 AND n >= 2),
z AS (SELECT DISTINCT tab FROM t WHERE grp IS NOT NULL GROUP BY tab, concept HAVING count(DISTINCT grp) > 1),
w AS (SELECT t.*, o.role, par.parent, row_ % 5 = 0 AS total FROM t JOIN o USING (tab) LEFT JOIN par ON par.role = o.role AND par.child = concept WHERE tab NOT IN (SELECT tab FROM z)),
b AS (SELECT *, CASE WHEN lag(1) OVER p IS NULL OR lag(grp) OVER p IS DISTINCT FROM grp THEN 1 ELSE 0 END AS b FROM w WINDOW p AS (PARTITION BY tab ORDER BY row_)),
r AS (SELECT *, sum(b) OVER (PARTITION BY tab ORDER BY row_) AS run FROM b),
c AS (SELECT tab, run, parent, count(*) AS n FROM r WHERE parent IS NOT NULL GROUP BY ALL), s AS (SELECT tab, run, parent AS shared FROM (SELECT *, sum(n) OVER (PARTITION BY tab, run) AS every FROM c) WHERE every >= 2 AND 2 * n > every),
g AS (SELECT r.tab, r.run, min(row_) AS start_, any_value(grp) AS grp FROM r WHERE grp IS NOT NULL GROUP BY 1, 2),
n AS (SELECT g.*, shared FROM g JOIN s USING (tab, run) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tab = g.tab AND r.grp IS NULL AND r.parent = shared AND r.row_ < g.start_))
SELECT r.tab, r.row_, n.grp, r.parent, n.shared, 'inside' AS kind FROM r JOIN n ON n.tab = r.tab AND n.run = r.run WHERE r.parent <> n.shared AND NOT total AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.role = r.role AND ((anc.child = r.parent AND anc.anc = n.shared) OR (anc.child = n.shared AND anc.anc = r.parent)))
UNION ALL SELECT r.tab, r.row_, n.grp, r.parent, n.shared, 'outside' FROM r JOIN n ON n.tab = r.tab AND n.run + 1 = r.run WHERE r.grp IS NULL AND r.parent = n.shared AND NOT total""")
def group_disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables, return flags as groups, parts as concepts of a binary tree in two roles."""
    numbers = table(spark, d, "part").select((F.col("p_partkey") % 14 + 1).alias("k")).distinct().where("k > 1")
    parents = numbers.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), "k").where("role = 0 or k % 3 > 0").select("role", F.col("k").cast("string").alias("child"), F.floor(F.col("k") / 2).cast("string").alias("parent"))
    flag = F.when(F.col("l_returnflag").isin("A", "N"), F.col("l_returnflag"))
    # arg_max leaves rows without a flag out, as it does in SQL.
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row")).agg(F.max("l_partkey").alias("p"), F.max_by(flag, F.when(flag.isNotNull(), F.col("l_partkey"))).alias("grp"))
    rows = lines.select("table", "row", F.when(F.col("row") % 5 == 0, "Total").otherwise("Line").alias("label"), "grp", (F.col("p") % 14 + 1).cast("string").alias("concept"))
    found = K.group_disagreements(rows, parents)
    return found.select(F.col("table").alias("tab"), F.col("row").alias("row_"), "grp", F.col("parent").cast("long").alias("parent"), F.col("shared").cast("long").alias("shared"), "kind")


_RUNS = """e AS (SELECT 'S' || (user_id % 3) || '.' || user_id || '-' || (event_id % 7) AS scenario, event_type AS execution, min(CAST(event_id // 7 % 3 AS VARCHAR) || '’s') AS text, min(CAST(event_id // 7 % 2 AS VARCHAR)) AS figures, min(CASE WHEN event_id % 5 = 0 THEN '-' ELSE 'g' || (event_id % 4) END) AS grade FROM events GROUP BY 1, 2),
s AS (SELECT scenario FROM e GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT execution) FROM e)), a AS (SELECT e.* FROM e JOIN s USING (scenario))"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    third = F.floor(F.col("event_id") / 7)
    scenario = F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string"), F.lit("."), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string"))
    grade = F.when(F.col("event_id") % 5 == 0, "-").otherwise(F.concat(F.lit("g"), (F.col("event_id") % 4).cast("string")))
    said = e.select(scenario.alias("scenario"), F.col("event_type").alias("execution"), F.concat((third % 3).cast("string"), F.lit("’s")).alias("text"), (third % 2).cast("string").alias("figures"), grade.alias("grade"))
    return K.in_every_execution(said.groupBy("scenario", "execution").agg(*(F.min(c).alias(c) for c in ("text", "figures", "grade"))))


@query("aligned_variation", f"""WITH {_RUNS}, k AS (SELECT scenario, split_part(scenario, '.', 1) AS qset, CASE WHEN count(DISTINCT grade) FILTER (grade <> '-') > 1 THEN 'Grade' WHEN count(DISTINCT figures) > 1 THEN 'Figures' WHEN count(DISTINCT text) > 1 THEN 'Wording' ELSE 'Identical' END AS v FROM a GROUP BY 1)
SELECT CASE WHEN grouping(qset) = 1 THEN 'All' ELSE qset END AS qset, count(*) AS n, count(*) FILTER (v = 'Identical') AS identical, count(*) FILTER (v = 'Wording') AS wording, count(*) FILTER (v = 'Figures') AS figures, count(*) FILTER (v = 'Grade') AS grade FROM k GROUP BY ROLLUP (qset)""")
def aligned_variation(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of events as runs of the same questions: how the answers vary, where every run has one."""
    return K.variation_counts(_runs(spark, d), F.split("scenario", r"\.")[0])


@query("aligned_pairs", f"""WITH {_RUNS} SELECT l.execution AS left_run, r.execution AS right_run, count(*) AS n, count(*) FILTER (l.text = r.text) AS same_text, count(*) FILTER (l.grade <> '-' AND r.grade <> '-') AS graded, count(*) FILTER (l.grade <> '-' AND r.grade <> '-' AND l.grade = r.grade) AS same_grade
 FROM a l JOIN a r ON l.scenario = r.scenario AND l.execution < r.execution GROUP BY 1, 2""")
def aligned_pairs(spark: SparkSession, d: str) -> DataFrame:
    return K.pairs_alike(_runs(spark, d))
