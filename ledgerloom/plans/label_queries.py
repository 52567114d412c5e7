"""Registered queries over labels: parts as roles, suppliers as tables, orders as rows, lines of texts as paragraphs, events as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import labels as L
from ledgerloom.plans.registry import query
from ledgerloom.storage import table

_TITLES = ("Statements of Comprehensive Income", "Cash Flows Statements", "Statements of Cash Flows", "Balance Sheets", "Stockholders Equity", "Statements of Operations", "Statements of Financial Position", "Segments")
_TYPES = ("comprehensive_income", None, "cash_flow_statement", "balance_sheet", "equity_statement", "income_statement", "balance_sheet", None)
_CHECKS = [c for _, _, concepts in L.STATEMENTS for c in concepts]
_ROLE = "CASE WHEN p_partkey % 23 = 0 THEN p_partkey % 8 WHEN p_partkey % 5 = 1 THEN 2 WHEN p_partkey % 5 = 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 6 END WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey % 5 + 1 END"
_LISTED = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query("role_types", f"""WITH r AS (SELECT p_partkey // 5 AS filing, p_partkey AS role, ({_LISTED(_TITLES)})[({_ROLE}) + 1] AS title FROM part),
h AS (SELECT r.*, [c FOR c IN {_LISTED(_CHECKS)} IF NOT (role % 11 = 0 AND length(c) % 2 = 0) AND NOT (role % 7 <> 0 AND title LIKE '%Compre%' AND c = 'us-gaap:EarningsPerShareBasic')] AS held FROM r),
t AS (SELECT *, CASE WHEN upper(title) LIKE '%COMPREHENSIVE%' THEN 'comprehensive_income' WHEN upper(title) LIKE '%CASH FLOW%' THEN 'cash_flow_statement' WHEN upper(title) LIKE '%BALANCE SHEET%' OR upper(title) LIKE '%FINANCIAL POSITION%' THEN 'balance_sheet' WHEN upper(title) LIKE '%EQUITY%' THEN 'equity_statement' WHEN upper(title) LIKE '%OPERATIONS%' THEN 'income_statement' END AS said FROM h),
b AS (SELECT *, coalesce(said = 'comprehensive_income' AND list_contains(held, 'us-gaap:EarningsPerShareBasic'), FALSE) AS both_ FROM t),
k AS (SELECT *, CASE WHEN both_ THEN 'income_statement' ELSE said END AS type FROM b),
c AS (SELECT *, CASE type WHEN 'comprehensive_income' THEN list_contains(held, 'us-gaap:ComprehensiveIncomeNetOfTax') WHEN 'cash_flow_statement' THEN list_contains(held, 'us-gaap:NetCashProvidedByUsedInOperatingActivities') WHEN 'balance_sheet' THEN list_contains(held, 'us-gaap:Assets') AND list_contains(held, 'us-gaap:LiabilitiesAndStockholdersEquity') WHEN 'equity_statement' THEN list_contains(held, 'us-gaap:StatementEquityComponentsAxis') ELSE list_contains(held, 'us-gaap:EarningsPerShareBasic') END AS confirmed FROM k),
m AS (SELECT filing, list(DISTINCT type) AS types, bool_or(both_) AS both_ FROM c GROUP BY 1),
w AS (SELECT c.*, count(*) OVER (PARTITION BY c.filing, c.type) AS n, list_sort([t FOR t IN ['comprehensive_income', 'cash_flow_statement', 'balance_sheet', 'equity_statement', 'income_statement'] IF NOT coalesce(list_contains(m.types, t), FALSE) AND NOT (m.both_ AND t = 'comprehensive_income')]) AS missing FROM c JOIN m USING (filing))
SELECT filing, role, type, CASE WHEN type IS NULL THEN 'no type by its title: ' || title WHEN NOT confirmed THEN 'does not present the concepts of ' || type WHEN n > 1 THEN 'two roles of ' || type WHEN len(missing) > 0 THEN 'missing ' || array_to_string(missing, ', ') END AS problem FROM w""")
def role_types(spark: SparkSession, d: str) -> DataFrame:
    """Five parts are a filing's statements, some titled alike, some without a concept that they need."""
    part = table(spark, d, "part")
    place = F.expr(_ROLE)
    roles = part.select(F.floor(F.col("p_partkey") / 5).alias("filing"), F.col("p_partkey").alias("role"), F.get(F.array(*(F.lit(t) for t in _TITLES)), place.cast("int")).alias("title"))
    held = roles.select("filing", "role", "title", F.explode(F.array(*(F.lit(c) for c in _CHECKS))).alias("concept"))
    gone = ((F.col("role") % 11 == 0) & (F.length("concept") % 2 == 0)) | ((F.col("role") % 7 != 0) & F.contains("title", F.lit("Compre")) & (F.col("concept") == "us-gaap:EarningsPerShareBasic"))
    return L.role_types(roles, held.where(~gone))


@query("statement_tables", """WITH r AS (SELECT DISTINCT f.filing, p_size AS role, p_brand AS concept FROM part, range(5) AS f(filing) WHERE p_size <= 8 AND p_partkey % 5 = f.filing AND p_partkey % 100 < 30),
t AS (SELECT DISTINCT l_suppkey % 5 AS filing, l_suppkey AS tab, p_brand AS concept FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 3 = l_suppkey % 3 AND l_linenumber = 1),
a AS (SELECT filing, role, count(*) AS n FROM r GROUP BY 1, 2), m AS (SELECT filing, role, tab, count(*) AS n FROM r JOIN t USING (filing, concept) GROUP BY 1, 2, 3),
b AS (SELECT filing, role, tab, n FROM (SELECT *, row_number() OVER (PARTITION BY filing, role ORDER BY n DESC, tab) AS k FROM m) WHERE k = 1),
c AS (SELECT a.filing, a.role, b.tab, coalesce(b.n / a.n, 0) AS coverage FROM a LEFT JOIN b USING (filing, role)), s AS (SELECT *, count(*) OVER (PARTITION BY filing, tab) AS shared FROM c)
SELECT filing, role, tab, round(coverage, 6) AS coverage, CASE WHEN coverage < 0.4 THEN 'none' WHEN shared > 1 THEN 'shared' END AS problem FROM s""")
def statement_tables(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of parts as roles that present brands, suppliers as tables that have them."""
    part = table(spark, d, "part")
    presented = part.where("p_size <= 8 and p_partkey % 100 < 30").select((F.col("p_partkey") % 5).alias("filing"), F.col("p_size").alias("role"), F.col("p_brand").alias("concept"))
    sold = table(spark, d, "lineitem").where("l_linenumber = 1").join(part, F.col("l_partkey") == F.col("p_partkey")).where(F.col("p_partkey") % 3 == F.col("l_suppkey") % 3)
    tables = sold.select((F.col("l_suppkey") % 5).alias("filing"), F.col("l_suppkey").alias("table"), F.col("p_brand").alias("concept"))
    roles = presented.select("filing", "role", F.col("role").cast("string").alias("type")).distinct()
    found = L.statement_tables(tables, roles, presented)
    problem = F.when(F.col("problem").startswith("no table"), "none").when(F.col("problem").isNotNull(), "shared")
    return found.select("filing", "role", F.col("table").alias("tab"), F.round("coverage", 6).alias("coverage"), problem.alias("problem"))


@query("row_periods", """WITH v AS (SELECT o_custkey AS tab, o_orderkey AS row_, k, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE ELSE (o_orderdate + INTERVAL 1 DAY * (k * (o_orderkey % 2)))::DATE END AS e,
  CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 364 ELSE 91 END AS days FROM orders, range(2) AS r(k)),
o AS (SELECT tab, row_, any_value(e) AS e, any_value(days) AS days FROM v WHERE e IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT e) = 1),
m AS (SELECT tab FROM o GROUP BY 1 HAVING count(DISTINCT (e, coalesce(days, -1))) > 1),
l AS (SELECT o_custkey AS tab, o_orderkey AS row_, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 10 = 1 THEN 'Paid in ' || year(o_orderdate) ELSE 'Paid' END AS label FROM orders)
SELECT l.tab, l.row_, CASE WHEN o.e IS NULL OR m.tab IS NULL OR label = '' OR contains(label, year(o.e)::VARCHAR) THEN label ELSE label || ' (' || CASE WHEN days IS NULL THEN 'as of ' || strftime(e, '%B %-d, %Y') WHEN days = 0 THEN 'on ' || strftime(e, '%B %-d, %Y')
  WHEN days = 364 THEN 'fiscal ' || year(e) || ', year ended ' || strftime(e, '%B %-d, %Y') ELSE 'three months ended ' || strftime(e, '%B %-d, %Y') END || ')' END AS label FROM l LEFT JOIN o USING (tab, row_) LEFT JOIN m USING (tab)""")
def row_periods(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as the rows of a table, two values each, dated by their contexts."""
    orders, key = table(spark, d, "orders"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    end = F.when(key % 7 == 0, None).when(key % 3 == 0, day).otherwise(F.date_add(day, (F.col("k") * (key % 2)).cast("int")))
    days = F.when(key % 4 == 1, 0).when(key % 4 == 2, 364).when(key % 4 == 3, 91)
    values = orders.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select((F.col("o_custkey") % 3).alias("filing"), F.col("o_custkey").alias("table"), key.alias("row"), F.lit("Amount").alias("column"), end.alias("e"), days.alias("days"))
    values = values.withColumn("context", F.concat_ws("/", "e", "days"))
    values = values.withColumn("context", F.when(F.col("e").isNotNull(), F.col("context")))
    dated = values.where("e is not null").select("filing", "context", "e", "days").distinct()
    contexts = dated.select("filing", "context", F.expr("date_sub(e, days)").alias("start"), F.when(F.col("days").isNotNull(), F.col("e")).alias("end"), F.when(F.col("days").isNull(), F.col("e")).alias("instant"), F.year("e").alias("fiscal_year"))
    label = F.when(key % 10 == 0, "").when(key % 10 == 1, F.concat(F.lit("Paid in "), F.year("o_orderdate").cast("string"))).otherwise("Paid")
    rows = orders.select((F.col("o_custkey") % 3).alias("filing"), F.col("o_custkey").alias("table"), key.alias("row"), label.alias("label"), F.lit(None).cast("string").alias("grp"))
    return L.row_periods(rows, values.select("filing", "table", "row", "column", "context"), contexts, fiscal=True).select(F.col("table").alias("tab"), F.col("row").alias("row_"), "label")


@query("page_break_joins", r"""WITH s AS (SELECT doc_id, string_split(replace(text, chr(10), ','), ',') AS l FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(range(len(l))) AS seq, unnest(l) AS text FROM s),
b AS (SELECT doc_id, seq, CASE WHEN seq % 9 = 4 THEN seq::VARCHAR ELSE trim(text) END AS text FROM u),
n AS (SELECT *, seq // 40 AS topic, regexp_matches(text, '^(?:F-)?\d{1,4}$') AS num FROM b),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seq) AS prior, lag(topic) OVER (PARTITION BY doc_id ORDER BY seq) AS prior_topic FROM n WHERE NOT num),
j AS (SELECT *, prior IS NOT NULL AND prior <> '' AND NOT regexp_matches(regexp_replace(prior, '[”"’)]+$', ''), '[.?!:;]$') AND regexp_matches(text, '^\p{Ll}') AND topic = prior_topic AS goes_on FROM p),
r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM j),
o AS (SELECT doc_id, min(seq) AS seq, string_agg(CASE WHEN NOT goes_on OR regexp_matches(prior, '[-—–]$') THEN text ELSE ' ' || text END, '' ORDER BY seq) AS text, count(*) AS pieces FROM r GROUP BY doc_id, run)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, md5(text) AS text, CAST(pieces AS INTEGER) AS pieces FROM o UNION ALL SELECT doc_id, CAST(seq AS INTEGER), md5(text), 1 FROM n WHERE num""")
def page_break_joins(spark: SparkSession, d: str) -> DataFrame:
    """What stands between commas and line ends as paragraphs, every ninth of them a page number, forty a topic."""
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "[,\n]", -1)).alias("seq", "text"))
    lines = lines.withColumn("text", F.when(F.col("seq") % 9 == 4, F.col("seq").cast("string")).otherwise(F.trim("text")))
    blocks = lines.select("doc", "seq", F.lit("text").alias("kind"), "text", F.floor(F.col("seq") / 40).alias("topic"))
    return L.joined_paragraphs(blocks).select(F.col("doc").alias("doc_id"), "seq", F.md5("text").alias("text"), "pieces")


@query("block_sections", """WITH RECURSIVE b AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, event_type IN ('purchase', 'signup') AS is_table, CASE WHEN event_type = 'purchase' THEN event_id % 3 WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 7 END AS statement, event_id // 1500 AS topic, event_type = 'error' AND event_id % 4 = 0 AS starts FROM events),
w AS (SELECT DISTINCT doc, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS topic, FALSE AS has, CAST(NULL AS BIGINT) AS last_table, CAST(NULL AS BIGINT) AS start_at FROM b
  UNION ALL SELECT b.doc, b.seq, b.topic, (b.statement IS NOT NULL) OR (w.has AND NOT fresh), CASE WHEN b.is_table THEN b.seq WHEN fresh THEN NULL ELSE w.last_table END,
    CASE WHEN fresh THEN b.seq WHEN b.statement IS NOT NULL AND w.has THEN w.last_table + 1 END
  FROM (SELECT b.*, w.topic IS DISTINCT FROM b.topic OR w.seq = 0 OR b.starts AS fresh FROM w JOIN b ON b.doc = w.doc AND b.seq = w.seq + 1) b JOIN w ON b.doc = w.doc AND b.seq = w.seq + 1)
SELECT doc, seq, CAST(sum(n) OVER (PARTITION BY doc ORDER BY seq) AS INTEGER) AS section FROM (SELECT b.doc, b.seq, count(s.start_at) AS n FROM b LEFT JOIN (SELECT DISTINCT doc, start_at FROM w) s ON s.doc = b.doc AND s.start_at = b.seq GROUP BY 1, 2)""")
def block_sections(spark: SparkSession, d: str) -> DataFrame:
    """Events as typed blocks: some are tables, some of these statements."""
    from pyspark.sql import Window

    e, key = table(spark, d, "events"), F.col("event_id")
    statement = F.when(F.col("event_type") == "purchase", key % 3).when((F.col("event_type") == "signup") & (key % 2 == 0), 7)
    blocks = e.select(F.col("user_id").alias("doc"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("seq"), F.when(F.col("event_type").isin("purchase", "signup"), "table").otherwise("text").alias("kind"), F.floor(key / 1500).alias("topic"), statement.cast("string").alias("statement_type"), ((F.col("event_type") == "error") & (key % 4 == 0)).alias("starts"))
    return L.block_sections(blocks).select("doc", "seq", "section")
