"""Registered queries over figures of answers. An order is a question, its lines are printed in three excerpts, and the
answer states a price, none, one and its rounding in millions, a sum that is printed nowhere, or one made up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import figures as G
from ledgerloom.plans.registry import query
from ledgerloom.storage import table

_ANSWERS = r"""l AS (SELECT l_orderkey AS id, l_linenumber AS k, CAST(floor(max(l_extendedprice)) AS BIGINT) AS price, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
x AS (SELECT id, 1 + k % 3 AS position, string_agg('Line ' || chr(CAST(64 + k AS INTEGER)) || ' — Price: ' || format('{:,}', price) || ' | Quantity: ' || q, chr(10) ORDER BY k) AS content FROM l GROUP BY 1, 2),
f AS (SELECT id, arg_min(price, k) AS price, min(k) AS k, sum(q) AS q, arg_min(q, k) AS q1, arg_max(q, k) AS q2, arg_max(price, k) AS price2, count(*) AS n FROM l GROUP BY 1),
a AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Nothing is said of it on December 31, 2025.' WHEN 1 THEN 'The price was $' || format('{:,}', price) || ' on March 5.'
    WHEN 2 THEN 'It was ' || format('{:,}', price) || ' thousand, about ' || printf('%.1f', (price + 50) // 100 / 10) || ' million.' WHEN 3 THEN 'Both make ' || format('{:,}', price + price2 + 100000) || '.' ELSE 'It was ' || format('{:,}', price + 7) || ' for ' || q1 || '.' END AS answer,
  format('{:,}', CASE WHEN id % 5 = 3 THEN price + price2 + 100000 ELSE price END) AS expect, ['Price: ' || format('{:,}', price), CASE WHEN id % 2 = 0 THEN 'Quantity: ' || q2 ELSE 'no such text' END] AS inputs FROM f),
n AS (SELECT id, answer, expect, inputs, regexp_replace(regexp_replace(answer, 'December 31|March 5', '', 'g'), '\b2025\b', '', 'g') AS bare FROM a),
t AS (SELECT id, list_distinct(regexp_extract_all(bare, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?')) AS figures, bare FROM n),
s AS (SELECT id, figure, CAST(instr(bare, figure) AS INTEGER) AS at_, CASE WHEN regexp_matches(bare, figure || ' million') THEN 6 END AS scale FROM (SELECT id, bare, unnest(figures) AS figure FROM t)),
p AS (SELECT id, position, unnest(list_distinct(regexp_extract_all(content, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?'))) AS figure FROM x),
g AS (SELECT s.*, (SELECT list(p.position ORDER BY p.position) FROM p WHERE p.id = s.id AND p.figure = s.figure) AS positions FROM s),
u AS (SELECT g.*, (SELECT arg_min(o.figure, o.at_) FROM g o, (VALUES (1), (1000), (1000000)) AS v(unit) WHERE o.id = g.id AND o.positions IS NOT NULL AND g.positions IS NULL AND g.scale IS NOT NULL
    AND CAST(round(CAST(replace(o.figure, ',', '') AS DECIMAL(20,4)) * v.unit / 1000000, 1) AS DECIMAL(20,1)) = CAST(replace(g.figure, ',', '') AS DECIMAL(20,1))) AS source FROM g),
w AS (SELECT u.id, u.at_, u.figure, coalesce(u.positions, o.positions) AS positions, u.source FROM u LEFT JOIN g o ON o.id = u.id AND o.figure = u.source)"""


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, answer, question, kind, passed, expect, inputs) and (id, position, content)."""
    # Dealt by order once: all that follows, up to the trace, is by order.
    dealt = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").repartition("l_orderkey")
    lines = dealt.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k")).agg(F.floor(F.max("l_extendedprice")).alias("price"), F.max("l_quantity").cast("long").alias("q"))
    commas = lambda c: F.format_number(c, 0)
    said = F.concat(F.lit("Line "), F.chr(64 + F.col("k")), F.lit(" — Price: "), commas("price"), F.lit(" | Quantity: "), F.col("q").cast("string"))
    excerpts = lines.groupBy("id", (1 + F.col("k") % 3).alias("position")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("said")))), lambda x: x["said"]), "\n").alias("content"))
    orders = lines.groupBy("id").agg(F.min_by("price", "k").alias("price"), F.min_by("q", "k").alias("q1"), F.max_by("q", "k").alias("q2"), F.max_by("price", "k").alias("price2"))
    price, kind, both = F.col("price"), F.col("id") % 5, F.col("price") + F.col("price2") + 100000
    tenths = F.floor((price + 50) / 100).cast("decimal(20,0)") / 10
    answer = (
        F.when(kind == 0, "Nothing is said of it on December 31, 2025.")
        .when(kind == 1, F.concat(F.lit("The price was $"), commas("price"), F.lit(" on March 5.")))
        .when(kind == 2, F.concat(F.lit("It was "), commas("price"), F.lit(" thousand, about "), tenths.cast("decimal(20,1)").cast("string"), F.lit(" million.")))
        .when(kind == 3, F.concat(F.lit("Both make "), commas(both), F.lit(".")))
        .otherwise(F.concat(F.lit("It was "), commas(price + 7), F.lit(" for "), F.col("q1").cast("string"), F.lit(".")))
    )
    inputs = F.array(F.concat(F.lit("Price: "), commas("price")), F.when(F.col("id") % 2 == 0, F.concat(F.lit("Quantity: "), F.col("q2").cast("string"))).otherwise("no such text"))
    answers = orders.select("id", answer.alias("answer"), F.lit("What was it?").alias("question"), F.lit("figure").alias("kind"), (kind == 1).alias("passed"), F.array(commas(F.when(kind == 3, both).otherwise(price))).alias("expect"), inputs.alias("inputs"))
    return answers, excerpts


@query("figure_trace", f"WITH {_ANSWERS} SELECT id, figure, array_to_string(positions, ',') AS positions, source AS rounds FROM w")
def figure_trace(spark: SparkSession, d: str) -> DataFrame:
    """Every figure that an answer states, the excerpts that print it and what it rounds."""
    return G.trace(*_answers(spark, d)).select("id", "figure", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "rounds")


@query("figure_source", f"""WITH {_ANSWERS}, c AS (SELECT a.id, count(w.figure) AS n, count(*) FILTER (w.figure IS NOT NULL AND w.positions IS NULL) AS lost, any_value(a.expect) AS expect, any_value(a.inputs) AS inputs FROM a LEFT JOIN w ON w.id = a.id GROUP BY 1)
SELECT id, CASE WHEN n = 0 THEN 'no figure stated' WHEN lost = 0 THEN 'traced' WHEN NOT list_contains(flatten([regexp_extract_all(i, '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?') FOR i IN inputs]), expect) THEN 'calculated' ELSE 'untraced' END AS status, lost AS missing FROM c""")
def figure_source(spark: SparkSession, d: str) -> DataFrame:
    """Whether each answer's figures are traced to its excerpts."""
    return G.figure_sources(*_answers(spark, d)).select("id", "status", F.coalesce(F.size("missing"), F.lit(0)).cast("long").alias("missing"))


@query("expected_location", f"""WITH {_ANSWERS}, m AS (SELECT id, expect, unnest(inputs) AS marker FROM a WHERE id % 5 <> 1),
o AS (SELECT m.id, bool_and(EXISTS (SELECT 1 FROM x WHERE x.id = m.id AND contains(x.content, m.marker))) AS all_in FROM m WHERE NOT list_contains(regexp_extract_all(marker, '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), expect) GROUP BY 1)
SELECT a.id, a.expect AS value, (SELECT string_agg(position, ',' ORDER BY position) FROM p WHERE p.id = a.id AND p.figure = a.expect) AS positions,
  CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.id = a.id AND p.figure = a.expect) THEN 'excerpt' WHEN o.all_in THEN 'derived' ELSE 'missed' END AS location FROM a LEFT JOIN o ON o.id = a.id WHERE a.id % 5 <> 1""")
def expected_location(spark: SparkSession, d: str) -> DataFrame:
    """Where the expected figure of each answer that did not pass is printed, or what it comes from."""
    return G.expected_locations(*_answers(spark, d)).select("id", "value", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "location")


@query("several_needles", f"""WITH {_ANSWERS}, m AS (SELECT id, unnest(inputs) AS needle FROM a), r AS (SELECT m.id, m.needle, min(x.position) FILTER (contains(x.content, m.needle)) AS first FROM m LEFT JOIN x ON x.id = m.id GROUP BY 1, 2)
SELECT id, CASE WHEN count(first) = count(*) THEN max(first) END AS rank FROM r GROUP BY 1""")
def several_needles(spark: SparkSession, d: str) -> DataFrame:
    """The position by which all of a question's inputs have been seen."""
    answers, excerpts = _answers(spark, d)
    return G.answer_rank(answers.select("id", F.explode("inputs").alias("needle")).distinct(), excerpts)
