"""Registered queries over functions, ordered rows and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import sequences as S
from ledgerloom.plans.registry import query
from ledgerloom.storage import table


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events")


@query("carry_forward_reset", """SELECT event_id, coalesce(nullif(last_value(CASE WHEN event_type = 'error' THEN 'RESET' WHEN event_type IN ('signup', 'purchase') THEN event_type END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'RESET'), 'narrative') AS state FROM events""")
def carry_forward_reset(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return S.carry_forward(_events(spark, d), "user_id", ["ts", "event_id"], F.when(kind.isin("signup", "purchase"), kind), kind == "error", "narrative", "state").select("event_id", "state")


@query("backfill_next", """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM events)
SELECT event_id, CASE WHEN last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL
 THEN first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) END AS topic FROM e""")
def backfill_next(spark: SparkSession, d: str) -> DataFrame:
    return S.backfill_next(_events(spark, d), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "topic").select("event_id", "topic")


@query("gaps_islands", """WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR event_type = 'signup' THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM e)
SELECT user_id, island, count(*) AS n FROM i GROUP BY ALL""")
def gaps_islands(spark: SparkSession, d: str) -> DataFrame:
    return S.islands(_events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "island").groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


_SPANS = "spans AS (SELECT event_id AS span_id, event_id % 7 AS grp, event_id AS a, event_id + (event_id % 13) * 40 AS b FROM events WHERE event_type = 'signup')"


def _spans(spark, d) -> DataFrame:
    e = _events(spark, d).where("event_type = 'signup'")
    return e.select(F.col("event_id").alias("span_id"), (F.col("event_id") % 7).alias("grp"), F.col("event_id").alias("a"), (F.col("event_id") + (F.col("event_id") % 13) * 40).alias("b"))


@query("range_join_spans", f"WITH {_SPANS} SELECT p.event_id, s.span_id FROM (SELECT event_id, event_id % 7 AS grp FROM events WHERE event_type = 'click') p JOIN spans s ON p.grp = s.grp AND p.event_id BETWEEN s.a AND s.b")
def range_join_spans(spark: SparkSession, d: str) -> DataFrame:
    points = _events(spark, d).where("event_type = 'click'").select("event_id", (F.col("event_id") % 7).alias("grp"))
    return S.within_spans(points, _spans(spark, d), "grp", "event_id", "a", "b", 128).select("event_id", "span_id")


@query("outermost_spans", f"WITH {_SPANS} SELECT span_id, grp FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.grp = s.grp AND o.span_id <> s.span_id AND o.a <= s.a AND o.b >= s.b)")
def outermost_spans(spark: SparkSession, d: str) -> DataFrame:
    return S.outermost(_spans(spark, d), "grp", "a", "b", "span_id").select("span_id", "grp")


@query("mode_tie_low", "SELECT l_suppkey, mode, n FROM (SELECT l_suppkey, l_linenumber AS mode, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1")
def mode_tie_low(spark: SparkSession, d: str) -> DataFrame:
    return S.mode_low(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber")


@query("coverage_argmax", """WITH have AS (SELECT DISTINCT l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), want AS (SELECT DISTINCT p_size, p_brand FROM part),
t AS (SELECT p_size, count(*) AS a FROM want GROUP BY 1), s AS (SELECT p_size, l_suppkey, count(*) / any_value(a) AS c FROM want JOIN have USING (p_brand) JOIN t USING (p_size) GROUP BY 1, 2)
SELECT p_size, l_suppkey, round(c, 6) AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY c DESC, l_suppkey) AS r FROM s) WHERE r = 1 AND c >= 0.4""")
def coverage_argmax(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    have = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return S.coverage(have, part, "l_suppkey", "p_size", "p_brand").withColumn("coverage", F.round("coverage", 6))


@query("first_wins", "SELECT user_id, event_type, arg_min(event_id, event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return S.first_wins(_events(spark, d), ["user_id", "event_type"], "event_id", "event_id")


@query("manifest_hashes", "SELECT source, sha256(string_agg(h, ',' ORDER BY bucket)) AS hash FROM (SELECT source, doc_id // 1000 AS bucket, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) GROUP BY source")
def manifest_hashes(spark: SparkSession, d: str) -> DataFrame:
    """A hash of each source: of the hashes of its buckets of 1,000 ids, so that no list grows with the source's texts."""
    joined = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "h"))), lambda r: r["h"]), ","), 256)
    rows = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 1000).alias("bucket"), "doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("source", "bucket").agg(joined("doc_id").alias("h")).groupBy("source").agg(joined("bucket").alias("hash"))


@query("manifest_diff", """WITH o AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id WHERE o.h IS DISTINCT FROM n.h""")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old = docs.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return S.changes(old, new, "doc_id", "h")


@query("cache_misses", "SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'purchase' AND c.user_id = e.user_id AND c.ts < e.ts) AND event_type = 'view'")
def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    stored = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("since"))
    asked = e.where("event_type = 'view'")
    return asked.join(stored, (asked["user_id"] == stored["user_id"]) & (stored["since"] < asked["ts"]), "left_anti").select("event_id")


@query("latest_iteration", "SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_iteration(spark: SparkSession, d: str) -> DataFrame:
    return E.latest(_events(spark, d), "user_id", "ts", ["event_id", "event_type"])


@query("report_order", "SELECT event_type, min(ts) AS first_ts, CAST(row_number() OVER (ORDER BY min(ts) DESC, event_type) AS INTEGER) AS place FROM events GROUP BY event_type")
def report_order(spark: SparkSession, d: str) -> DataFrame:
    first = _events(spark, d).groupBy("event_type").agg(F.min("ts").alias("first_ts"))  # a row for each execution
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.col("first_ts").desc(), "event_type")))


def _ranked(spark, d) -> tuple[DataFrame, DataFrame]:
    """The questions, and for each that is found the rank of the first document with its passage: how many come before it."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("needle"))  # the stated set of questions
    docs = table(spark, d, "documents")
    place = F.struct((F.col("doc_id") % 97).alias("p"), F.col("doc_id").alias("id"))
    first = E.holders(items, docs.select(F.col("doc_id").alias("key"), place.alias("place"), F.col("text").alias("content"))).groupBy("question_id").agg(F.min("place").alias("at"))
    # Places before: whole residues, of which there are 97, and of the same one those with a smaller id.
    sizes = docs.groupBy((F.col("doc_id") % 97).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = first.select("question_id", F.col("at.p").alias("at_p")).join(F.broadcast(sizes), F.col("p") < F.col("at_p"), "left").groupBy("question_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"))
    own = first.select("question_id", F.col("at.p").alias("p"), F.col("at.id").alias("at_id"))
    beside = docs.select("doc_id", (F.col("doc_id") % 97).alias("p")).join(own, "p").where(F.col("doc_id") <= F.col("at_id")).groupBy("question_id").agg(F.count(F.lit(1)).alias("beside"))
    return items, before.join(beside, "question_id").select("question_id", (F.col("before") + F.col("beside")).cast("int").alias("rank"))


_RANKS = "r AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id % 97, doc_id) AS rank FROM documents), n AS (SELECT item_id AS question_id, min(rank) AS rank FROM benchmark b LEFT JOIN r ON contains(r.text, b.text) GROUP BY 1)"


@query("rank_of_needle", f"WITH {_RANKS} SELECT question_id, CAST(rank AS INTEGER) AS rank FROM n")
def rank_of_needle(spark: SparkSession, d: str) -> DataFrame:
    items, ranks = _ranked(spark, d)
    return items.select("question_id").join(ranks, "question_id", "left")


@query("recall_mrr_rollup", f"WITH {_RANKS}, s AS (SELECT CASE question_id % 3 WHEN 0 THEN 'Main' WHEN 1 THEN 'HeldOut' ELSE 'AnswerSide' END AS qset, rank FROM n) SELECT coalesce(qset, 'All') AS qset, count(*) AS n, count(*) FILTER (rank <= 1) AS recall_1, count(*) FILTER (rank <= 5) AS recall_5, count(*) FILTER (rank <= 8) AS recall_8, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr FROM s GROUP BY ROLLUP (qset)")
def recall_mrr_rollup(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("question_id") % 3 == 0, "Main").when(F.col("question_id") % 3 == 1, "HeldOut").otherwise("AnswerSide")
    return E.metrics(rank_of_needle(spark, d).withColumn("qset", kind), "qset")


@query("number_tokens", r"SELECT conv_id, turn, regexp_extract_all(text, '\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?') AS tokens FROM conversations")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.number_tokens(F.col("text")).alias("tokens"))


@query("question_tags", r"""WITH u AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'fact' ELSE 'negative' END AS kind, CASE WHEN conv_id % 2 = 0 THEN ['4,120'] ELSE ['30', 'kilns'] END AS expect,
  CASE conv_id % 3 WHEN 0 THEN ['10 cups', '20 bowls'] WHEN 1 THEN ['4,120'] ELSE ['sold 4,120', '30'] END AS inputs, turn % 4 = 0 AS trapped, CASE conv_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['ABC-10K-2031.html'] WHEN 2 THEN ['ABC-10K-2031.html', 'XYZ-10K-2031.html'] END AS filings FROM conversations)
SELECT conv_id, turn, list_filter(['kind:' || kind, CASE WHEN len(inputs) >= 2 AND NOT list_has_any(flatten([regexp_extract_all(e, '\d{1,3}(?:,\d{3})+|\d+') FOR e IN expect]), flatten([regexp_extract_all(i, '\d{1,3}(?:,\d{3})+|\d+') FOR i IN inputs])) THEN 'calculation' END, CASE WHEN trapped THEN 'has traps' END], lambda x: x IS NOT NULL)
  || CASE WHEN len(filings) > 0 THEN ['company:' || string_split(f, '-')[1] FOR f IN filings] ELSE ['company:none'] END || [CASE WHEN turn % 5 = 0 THEN 'statement:balance_sheet' ELSE 'statement:none' END] || CASE WHEN conv_id % 7 = 0 THEN ['ollama:0.5'] ELSE [] END AS tags FROM u""".replace("\\\\d", "\\d"))
def question_tags(spark: SparkSession, d: str) -> DataFrame:
    """Turns as questions, with what is expected of them and where they were routed."""
    conv, turn = F.col("conv_id"), F.col("turn")
    texts = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<string>")
    made = {
        "kind": F.when(turn % 3 == 0, "figure").when(turn % 3 == 1, "fact").otherwise("negative"), "expect": F.when(conv % 2 == 0, texts("4,120")).otherwise(texts("30", "kilns")),
        "inputs": F.when(conv % 3 == 0, texts("10 cups", "20 bowls")).when(conv % 3 == 1, texts("4,120")).otherwise(texts("sold 4,120", "30")), "traps": F.when(turn % 4 == 0, texts("7")),
        "filings": F.when(conv % 4 == 0, texts()).when(conv % 4 == 1, texts("ABC-10K-2031.html")).when(conv % 4 == 2, texts("ABC-10K-2031.html", "XYZ-10K-2031.html")),
        "statement": F.when(turn % 5 == 0, "balance_sheet"), "version": F.when(conv % 7 == 0, "0.5"),
    }
    return table(spark, d, "conversations").select("conv_id", "turn", E.question_tags(*made.values()).alias("tags"))


@query("judge_agreement", "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS both_pass, count(*) FILTER (quality = 1 AND toxic = 1) AS strict_only, count(*) FILTER (quality = 0 AND toxic = 0) AS judge_only, count(*) FILTER (quality = 0 AND toxic = 1) AS both_fail, round_even(avg(((quality = 1) = (toxic = 0))::INT) * 100, 1) AS agree_percent FROM labels")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    verdicts = table(spark, d, "labels").select((F.col("quality") == 1).alias("strict"), (F.col("toxic") == 0).alias("judge"))
    return E.agreement(verdicts, "strict", "judge")


@query("score_pivot", "SELECT quality, count(*) FILTER (s = 1) AS score_1, count(*) FILTER (s = 2) AS score_2, count(*) FILTER (s = 3) AS score_3, count(*) FILTER (s = 4) AS score_4, count(*) FILTER (s = 5) AS score_5 FROM (SELECT quality, doc_id % 5 + 1 AS s FROM labels) GROUP BY quality")
def score_pivot(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "labels").withColumn("s", F.col("doc_id") % 5 + 1)
    return scored.groupBy("quality").agg(*(F.count_if(F.col("s") == k).alias(f"score_{k}") for k in range(1, 6)))


@query("variance_class", "SELECT md5(string_split(text, ' ')[1]) AS scenario, count(*) AS n, CASE WHEN count(DISTINCT lang) > 1 THEN 'Grade' WHEN count(DISTINCT n_chars) > 1 THEN 'Figures' WHEN count(DISTINCT replace(text, '’', '''')) > 1 THEN 'Wording' ELSE 'Identical' END AS variation FROM documents GROUP BY 1")
def variance_class(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return E.variation(docs.select(F.md5(F.split("text", " ")[0]).alias("scenario"), "text", F.col("n_chars").alias("figures"), F.col("lang").alias("grade")))


@query("pairwise_same", "WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT a.event_type AS left_run, b.event_type AS right_run, count(*) AS shared, count(*) FILTER (a.n = b.n) AS same FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL")
def pairwise_same(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    a, b = e.select("user_id", F.col("event_type").alias("left_run"), "n"), e.select("user_id", F.col("event_type").alias("right_run"), F.col("n").alias("m"))
    return a.join(b, "user_id").where("left_run < right_run").groupBy("left_run", "right_run").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("n") == F.col("m")).alias("same"))


@query("moves_vs_baseline", "WITH b AS (SELECT doc_id, n_chars % 17 + 1 AS old_rank FROM documents), n AS (SELECT doc_id, n_chars % 13 + 1 AS new_rank FROM documents WHERE doc_id % 3 <> 0) SELECT doc_id, old_rank, new_rank, round(1.0::DOUBLE / new_rank - 1.0::DOUBLE / old_rank, 6) AS gain FROM n LEFT JOIN b USING (doc_id) WHERE old_rank <> new_rank")
def moves_vs_baseline(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    old, new = docs.select("doc_id", (F.col("n_chars") % 17 + 1).alias("old_rank")), docs.where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") % 13 + 1).alias("new_rank"))
    both = new.join(old, "doc_id", "left").where("old_rank <> new_rank")
    return both.select("doc_id", "old_rank", "new_rank", F.round(1.0 / F.col("new_rank") - 1.0 / F.col("old_rank"), 6).alias("gain"))


@query("fiscal_year", "SELECT o_orderkey, (SELECT max(1995 + k) FROM range(-10, 11) t(k) WHERE abs(date_diff('day', (DATE '1995-06-30' + to_months(12 * k::INT))::DATE, o_orderdate::DATE)) <= 7)::INTEGER AS fiscal FROM orders")
def fiscal_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.fiscal_year(F.to_date("o_orderdate"), 1995, "1995-06-30").alias("fiscal"))


@query("period_label", """WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS a, (o_orderdate::DATE + ((o_orderkey % 4) * 91 + CASE WHEN o_orderkey % 4 = 3 THEN 92 ELSE 0 END)::INT) AS b FROM orders)
SELECT o_orderkey, CASE WHEN a IS NULL THEN 'as of ' || strftime(b, '%B %-d, %Y') WHEN b - a = 0 THEN 'on ' || strftime(b, '%B %-d, %Y') WHEN b - a BETWEEN 350 AND 380 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'fiscal ' || year(b) || ', ' ELSE '' END || 'year ended ' || strftime(b, '%B %-d, %Y')
 WHEN b - a BETWEEN 85 AND 95 THEN 'three months ended ' || strftime(b, '%B %-d, %Y') ELSE strftime(a, '%B %-d, %Y') || ' to ' || strftime(b, '%B %-d, %Y') END AS label FROM p""")
def period_label(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    end = F.date_add(day, ((k % 4) * 91 + F.when(k % 4 == 3, 92).otherwise(0)).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", N.period_label(F.when(k % 5 != 0, day), end, F.when(k % 3 == 0, F.year(end))).alias("label"))


@query("chunk_stats", "SELECT source, count(*) AS chunks, min(t) AS least, max(t) AS most, round(avg(t), 6) AS mean FROM (SELECT source, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) AS t FROM documents) GROUP BY source")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda x: x != "")).cast("long")
    return table(spark, d, "documents").select("source", tokens.alias("t")).groupBy("source").agg(F.count(F.lit(1)).alias("chunks"), F.min("t").alias("least"), F.max("t").alias("most"), F.round(F.avg("t"), 6).alias("mean"))


@query("drop_noise_lines", r"SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) WHERE NOT (regexp_full_match(line, '(?:F-)?\d{1,4}') OR regexp_full_match(line, '(?:\\?[-_*=~.]){3,}') OR regexp_full_match(line, '(?i)item\s+\d{1,2}[a-z]?')) GROUP BY doc_id")
def drop_noise_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(~T.is_noise(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query("embed_text", r"""WITH l AS (SELECT doc_id, source, text, [trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') FOR x IN string_split(text, chr(10))] AS lines FROM documents),
t AS (SELECT *, [trim(string_split(trim(x, '|'), '|')[1]) FOR x IN lines IF starts_with(x, '|')] AS firsts FROM l),
r AS (SELECT *, list_filter(firsts, lambda x: length(x) >= 2 AND regexp_matches(x, '\pL')) AS named FROM t)
SELECT doc_id, md5('search_document: ' || source || CASE WHEN len(firsts) = 0 THEN '' WHEN len(named) = 0 THEN chr(10) || 'Financial data table.'
 ELSE chr(10) || 'Financial data table with rows: ' || array_to_string(list_filter(named, lambda x, i: list_position(named, x) = i), ', ') || '.' END || chr(10) || chr(10) || text) AS hash FROM r""")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.embedding_text(F.col("source"), F.col("text"), "search_document: {}").cast("binary")).alias("hash"))


@query("rounding_link", """WITH f AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, (floor(l_extendedprice / 100)::BIGINT // 10) || '.' || (floor(l_extendedprice / 100)::BIGINT % 10) AS fig FROM lineitem)
SELECT l_orderkey, l_linenumber, fig AS figure, fig::DECIMAL(16,1) > 0 AND list_bool_or([floor(CAST(round(v * 100) AS HUGEINT) * u * 10 / 100 / 1000000 + 0.5) = CAST(fig::DECIMAL(16,1) * 10 AS BIGINT) FOR u IN [1, 1000, 1000000]]) AS linked FROM f""")
def rounding_link(spark: SparkSession, d: str) -> DataFrame:
    """Prices cut to a tenth of a thousand, read as millions, held against the price in ones, thousands and millions."""
    tenths = F.floor(F.col("l_extendedprice") / 100)
    figure, source = F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10), F.format_string("%.2f", F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", figure.alias("figure"), N.rounds_to(figure, F.lit(1_000_000).cast("long"), source).alias("linked"))


_NUM = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"


@query("strict_grade", rf"""WITH a AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'fact' WHEN 2 THEN 'negative' ELSE 'routing' END AS kind, regexp_extract_all(text, '{_NUM}') AS tokens,
 list_filter(regexp_extract_all(regexp_replace(regexp_replace(text, '{T.CITATION}', ' ', 'g'), '{T.DATE_DAY}', ' ', 'g'), '{_NUM}'), lambda t: NOT regexp_full_match(t, '(19|20)\d\d')) AS figures,
 regexp_matches(text, '{E.DECLINE.replace(chr(39), chr(39) * 2)}') AS declines, CASE WHEN conv_id % 2 = 0 THEN '7' ELSE 'the' END AS e FROM conversations),
b AS (SELECT *, list_contains(tokens, e) AS has, contains(lower(text), e) AS low, declines AND len(figures) = 0 AS declined FROM a)
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{E.UNIT_ONLY}') THEN 'malformed'
 WHEN kind = 'negative' THEN CASE WHEN declined THEN 'decline-ok' WHEN declines THEN 'check' ELSE 'wrong' END
 WHEN kind = 'fact' THEN CASE WHEN low OR has THEN 'reliable' WHEN declined THEN 'declined' WHEN declines THEN 'check' ELSE 'wrong' END
 WHEN has THEN 'reliable' WHEN kind = 'routing' AND declined THEN 'decline-ok' WHEN declined THEN 'declined' WHEN declines THEN 'check' ELSE 'wrong' END AS status FROM b""")
def strict_grade(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as answers; units, lookalikes and alternatives are held against golden values in the tests."""
    kind = F.element_at(F.array(*(F.lit(k) for k in ("figure", "fact", "negative", "routing"))), (F.col("turn") % 4 + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    made = {"answer": F.col("text"), "question": F.lit(""), "kind": kind, "unit": F.lit(None).cast("string"), "expect": F.array(F.when(F.col("conv_id") % 2 == 0, "7").otherwise("the")), "conflicts": none, "traps": none, "accept": F.lit(None).cast("array<struct<value:string,if_label:string>>"), "exact": F.lit(False), "decline_ok": F.lit(False)}
    return E.strict_grades(table(spark, d, "conversations").select("conv_id", "turn", *(v.alias(k) for k, v in made.items()))).select("conv_id", "turn", "status")


@query("nearest_interval", """SELECT l_orderkey, l_linenumber, k AS column_no FROM (SELECT l_orderkey, l_linenumber, k, row_number() OVER (PARTITION BY rid ORDER BY greatest(0, k * 12 - l_quantity, l_quantity - (k * 12 + 6)), k) AS r
 FROM (SELECT *, row_number() OVER () AS rid FROM lineitem), range(0, 5) t(k)) WHERE r = 1""")
def nearest_interval(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    columns = F.array(*(F.struct(F.greatest(F.lit(0.0), F.lit(12.0 * k) - q, q - (12.0 * k + 6)).alias("far"), F.lit(k).cast("long").alias("k")) for k in range(5)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_min(columns)["k"].alias("column_no"))


@query("html_links", r"SELECT page_id, len(regexp_extract_all(html, '<a\s+href=\"[^\"]*\"')) AS links FROM pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r'<a\s+href="[^"]*"'), 0)).cast("long").alias("links"))


@query("stream_guard", """SELECT user_id, CASE arg_max(event_type, event_id) FILTER (event_type IN ('error', 'click')) WHEN 'error' THEN 'filtered' WHEN 'click' THEN CASE WHEN count(*) FILTER (value > 0) = 0 THEN 'starved' ELSE 'ok' END ELSE 'ok' END AS outcome FROM events GROUP BY user_id""")
def stream_guard(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the answer-stream guard: tokens are events, `error` a filter finish, `click` a length finish."""
    from ledgerloom.streaming.guard import outcome

    e = _events(spark, d)
    finish = F.when(F.col("event_type") == "error", "content_filter").when(F.col("event_type") == "click", "length")
    rows = e.select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("seq"), F.when(F.col("value") > 0, "x").otherwise("").alias("text"), finish.alias("finish_reason"))
    return outcome(rows).withColumnRenamed("answer_id", "user_id")
