"""Registered queries over retrieval operators. Companies are `label`s, chunks are documents, questions the rows whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.stems import stemmed_words
from ledgerloom.operators import asking as A
from ledgerloom.operators import retrieval as R
from ledgerloom.plans.registry import query
from ledgerloom.storage import table

#: The registered questions: every vector and every benchmark passage whose id is divisible by EVERY.
EVERY, TOP = 20, 10


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    asked = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("q"), F.col("label").alias("company"))
    return asked, v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), "label")


def _terms(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0)
    return b.select(F.col("item_id").alias("question_id"), F.explode(T.keyword_terms(F.col("text"))).alias("term"))


def _bm25(spark, d, k: int, allowed: DataFrame | None = None) -> DataFrame:
    docs, terms = table(spark, d, "documents"), _terms(spark, d)
    return R.bm25(terms, R.postings(docs, "doc_id", "text", only=terms), R.lengths(docs, "doc_id", "text"), k, allowed)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_DIST = "round(list_cosine_distance(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9)"
_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_TERMS = f"terms AS (SELECT DISTINCT item_id AS question_id, w AS term FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS w FROM benchmark WHERE item_id % {EVERY} = 0) WHERE w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '(19|20)[0-9][0-9]'))"
_BM25 = f"""{_TERMS},
words AS (SELECT doc_id AS key, unnest({_WORDS.format('text')}) AS term FROM documents),
lens AS (SELECT doc_id AS key, len({_WORDS.format('text')}) AS length FROM documents),
stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
tf AS (SELECT term, key, count(*) AS tf FROM words WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT question_id, key, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
  FROM tf JOIN df USING (term) JOIN lens USING (key) JOIN terms USING (term), stats GROUP BY ALL)"""
_VEC = f"""vec AS (SELECT q.vec_id AS question_id, c.vec_id AS key, {_DIST} AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0)"""
_SAME = f"""same AS (SELECT q.vec_id AS question_id, c.vec_id AS key, {_DIST} AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0 AND q.label = c.label)"""


@query("vector_topk", f"WITH {_VEC} SELECT question_id, key, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM vec WHERE rank <= {TOP}")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, d), TOP).withColumn("distance", F.round("distance", 6))


@query("vector_topk_filtered", f"WITH {_SAME} SELECT question_id, key, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM same WHERE rank <= {TOP}")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_topk(*_vectors(spark, d), TOP, (("company", "label"),)).withColumn("distance", F.round("distance", 6))


@query("keyword_query_build", f"""SELECT conv_id, turn, nullif(array_to_string([('"' || w || '"') FOR w IN list_filter(t, lambda w, i: list_position(t, w) = i)], ' OR '), '') AS query
FROM (SELECT conv_id, turn, list_filter({_WORDS.format('text')}, lambda w: w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '(19|20)[0-9][0-9]')) AS t FROM conversations WHERE role = 'user')""")
def keyword_query_build(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.keyword_query(F.col("text")).alias("query"))


@query("postings", f"SELECT doc_id AS key, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY ALL")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(table(spark, d, "documents"), "doc_id", "text")


@query("stemmed_postings")
def stemmed_postings(spark: SparkSession, d: str) -> DataFrame:
    """The index over stems; DuckDB has no stemmer offline, so it is held against a plain count in the tests."""
    return R.postings(table(spark, d, "documents"), "doc_id", "text", stemmed_words)


@query("doc_lengths", f"SELECT doc_id AS key, len({_WORDS.format('text')}) AS length FROM documents")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return R.lengths(table(spark, d, "documents"), "doc_id", "text")


@query("term_stats", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_stats(spark: SparkSession, d: str) -> DataFrame:
    return postings(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("bm25_topk", f"WITH {_BM25} SELECT question_id, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS rank FROM bm) WHERE rank <= {TOP}")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d, TOP).withColumn("score", F.round("score", 6))


@query("bm25_topk_filtered", f"WITH {_BM25} SELECT question_id, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT bm.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS rank FROM bm JOIN documents ON doc_id = key WHERE lang = 'en') WHERE rank <= {TOP}")
def bm25_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return _bm25(spark, d, TOP, docs).withColumn("score", F.round("score", 6))


def _lists(spark, d) -> list[DataFrame]:
    asked, chunks = _vectors(spark, d)
    return [R.vector_topk(asked, chunks, R.DEPTH), _bm25(spark, d, R.DEPTH), R.vector_topk(asked, chunks, R.DEPTH, (("company", "label"),))]


_KW = f"kw AS (SELECT question_id, key, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS rank FROM bm)"


def _fused(names: list[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT question_id, key, rank, {i} AS list FROM {n} WHERE rank <= {R.DEPTH}" for i, n in enumerate(names))
    ranks = ", ".join(f"max(rank) FILTER (list = {i}) AS r{i}" for i in range(len(names)))
    score = " + ".join(["0.0::DOUBLE", *(f"coalesce(1.0::DOUBLE / ({R.RRF_K} + r{i}), 0.0)" for i in range(len(names)))])
    seen = "coalesce(" + ", ".join(f"{i} * 1000000 + r{i}" for i in range(len(names))) + ")"
    return f"fused AS (SELECT question_id, key, {score} AS score, {seen} AS seen FROM (SELECT question_id, key, {ranks} FROM ({parts}) GROUP BY ALL)), ordered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS rank FROM fused)"


_OUT = "SELECT question_id, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ordered"


@query("rrf_two_lists", f"WITH {_BM25}, {_VEC}, {_KW}, {_fused(['vec', 'kw'])} {_OUT} WHERE rank <= {TOP}")
def rrf_two_lists(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_lists(spark, d)[:2], TOP).withColumn("score", F.round("score", 6))


@query("rrf_boost_list", f"WITH {_VEC}, {_SAME}, {_fused(['vec', 'same'])} {_OUT} WHERE rank <= {TOP}")
def rrf_boost_list(spark: SparkSession, d: str) -> DataFrame:
    lists = _lists(spark, d)
    return R.fuse([lists[0], lists[2]], TOP).withColumn("score", F.round("score", 6))


@query("hybrid_search", f"WITH {_BM25}, {_VEC}, {_SAME}, {_KW}, {_fused(['vec', 'kw', 'same'])} {_OUT} WHERE rank <= {TOP}")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(_lists(spark, d), TOP).withColumn("score", F.round("score", 6))


_PER = f"per AS (SELECT q.vec_id AS question_id, c.label AS company, c.vec_id AS key, row_number() OVER (PARTITION BY q.vec_id, c.label ORDER BY {_DIST}, c.vec_id) AS rank FROM embeddings q, embeddings c WHERE q.vec_id % {EVERY} = 0)"


@query("interleave_companies", f"WITH {_PER}, many AS (SELECT question_id, count(DISTINCT company) AS n FROM per GROUP BY 1), kept AS (SELECT per.* FROM per JOIN many USING (question_id) WHERE rank <= ceil({TOP} / n::DOUBLE)), placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, company) AS place FROM kept) SELECT question_id, company, key, CAST(rank AS INTEGER) AS rank, CAST(place AS INTEGER) AS place FROM placed WHERE place <= {TOP}")
def interleave_companies(spark: SparkSession, d: str) -> DataFrame:
    asked, chunks = _vectors(spark, d)
    ranked = R.vector_topk(asked, chunks, TOP, by="label").withColumnRenamed("label", "company")
    return R.interleave(ranked, TOP)


_REL = f"rel AS (SELECT doc_id AS key, len(list_filter({_WORDS.format('text')}, lambda w: length(w) > 6)) AS relevance FROM documents)"
_HYBRID = f"{_BM25}, {_VEC}, {_KW}, {_fused(['vec', 'kw'])}"
_RERANK = f"{_HYBRID}, {_REL}, re AS (SELECT question_id, o.key, o.score, o.rank AS hybrid_rank, relevance, row_number() OVER (PARTITION BY question_id ORDER BY relevance DESC, o.rank) AS rank FROM ordered o JOIN rel ON o.key = rel.key WHERE o.rank <= 25)"


def _candidates(spark, d) -> DataFrame:
    """The fused list with what a reranker makes of each candidate: here its number of words of over six letters."""
    docs = table(spark, d, "documents")
    relevance = F.regexp_count(F.lower("text"), F.lit("[a-z0-9]{7,}")).alias("relevance")
    return R.fuse(_lists(spark, d)[:2], R.DEPTH).join(docs.select(F.col("doc_id").alias("key"), relevance), "key")


@query("rerank_stable", f"WITH {_RERANK} SELECT question_id, key, CAST(hybrid_rank AS INTEGER) AS hybrid_rank, relevance, CAST(rank AS INTEGER) AS rank FROM re WHERE rank <= {TOP}")
def rerank_stable(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_candidates(spark, d).drop("score"), TOP, 25).withColumn("relevance", F.col("relevance").cast("long"))


def _both_orders(spark, d) -> DataFrame:
    return R.rerank(_candidates(spark, d), 25, 25).withColumnRenamed("rank", "rerank_rank")


@query("blend2", f"WITH {_RERANK} SELECT question_id, key, round(1.0::DOUBLE / (60 + hybrid_rank) + 1.0::DOUBLE / (60 + rank), 6) AS blended FROM re")
def blend2(spark: SparkSession, d: str) -> DataFrame:
    return R.blend(_both_orders(spark, d), 2).select("question_id", "key", F.round("blended", 6).alias("blended"))


@query("blend4", f"WITH {_RERANK} SELECT question_id, key, round(score + 1.0::DOUBLE / (60 + rank), 6) AS blended FROM re")
def blend4(spark: SparkSession, d: str) -> DataFrame:
    return R.blend(_both_orders(spark, d), 4).select("question_id", "key", F.round("blended", 6).alias("blended"))


_SCALED = "coalesce(({0} - min({0}) OVER w) / nullif(max({0}) OVER w - min({0}) OVER w, 0), 0)"


@query("score_fusion", f"""WITH {_BM25}, {_VEC}, t AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, key) AS rank FROM bm),
j AS (SELECT coalesce(v.question_id, t.question_id) AS question_id, coalesce(v.key, t.key) AS key, 1 - v.distance AS near, t.score AS score
  FROM (SELECT * FROM vec WHERE rank <= {R.DEPTH}) v FULL JOIN (SELECT * FROM t WHERE rank <= {R.DEPTH}) t ON v.question_id = t.question_id AND v.key = t.key)
SELECT question_id, key, round({_SCALED.format("near")} * 0.7 + {_SCALED.format("score")} * 0.3, 6) AS fused FROM j WINDOW w AS (PARTITION BY question_id)""")
def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    near = R.vector_topk(*_vectors(spark, d), R.DEPTH).select("question_id", "key", (1 - F.col("distance")).alias("near"))
    both = near.join(_bm25(spark, d, R.DEPTH).select("question_id", "key", "score"), ["question_id", "key"], "full_outer")
    return R.weighted_fusion(both, {"near": 0.7, "score": 0.3}).select("question_id", "key", F.round("fused", 6).alias("fused"))


@query("prompt_assembly", f"""WITH {_BM25}, {_KW} SELECT question_id, 'Answer from the excerpts.' || chr(13) || chr(10) || 'Name the filing.' AS system, 'Context excerpts:' || chr(10) || chr(10)
 || string_agg('--- Excerpt from ' || source || ', section ' || lang || ' ---' || chr(10) || d.text || chr(10) || chr(10), '' ORDER BY rank) || chr(10) || 'Question: ' || any_value(b.text) AS user
 FROM kw JOIN documents d ON d.doc_id = kw.key JOIN benchmark b ON b.item_id = question_id WHERE rank <= 5 GROUP BY question_id""")
def prompt_assembly(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("filing"), F.col("lang").alias("heading"), F.col("text").alias("content"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    return R.prompt(_bm25(spark, d, 5).join(docs, "key").join(asked, "question_id"), "Answer from the excerpts.\nName the filing.")


@query("prompt_fit", "SELECT CAST(coalesce(sum(t), 0) + 300 + 100 AS BIGINT) AS tokens FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents ORDER BY t DESC LIMIT 5)")
def prompt_fit(spark: SparkSession, d: str) -> DataFrame:
    return R.largest_prompt(R.lengths(table(spark, d, "documents"), "doc_id", "text"), "length", 5, 300)


_LEXICON = {"marketing": ("promo",), "retail": ("economy", "standard"), "industry": ("brushed steel",), "raw": ("steel", "tin")}
_VALUES = ", ".join(f"('{k}', '{t}')" for t, ks in _LEXICON.items() for k in ks)


@query("lexicon_resolve_longest", f"""WITH lex(k, t) AS (VALUES {_VALUES}), hit AS (SELECT p_partkey, k, t FROM part, lex WHERE contains(lower(p_type), k)),
kept AS (SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.p_partkey = h.p_partkey AND o.k <> h.k AND contains(o.k, h.k)))
SELECT p.p_partkey, CASE WHEN count(DISTINCT t) = 1 THEN min(t) END AS resolved FROM part p LEFT JOIN kept USING (p_partkey) GROUP BY 1""")
def lexicon_resolve_longest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.statement_of_question(F.col("p_type"), _LEXICON).alias("resolved"))


@query("synthesis_flag", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{w}')" for w in T.SYNTHESIS) + " AS synthesis FROM conversations")
def synthesis_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.needs_synthesis(F.col("text")).alias("synthesis"))


@query("whole_word_route", """SELECT s.p_partkey, list_sort(list(r.w) FILTER (r.w IS NOT NULL)) AS routed FROM part s LEFT JOIN (VALUES ('tin'), ('steel'), ('copper'), ('brass'), ('nickel')) r(w)
ON regexp_matches(s.p_type, '(?i)\\b' || r.w || '\\b') GROUP BY 1""")
def whole_word_route(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_sort(F.array(*(F.lit(w) for w in ("tin", "steel", "copper", "brass", "nickel"))))
    found = F.filter(names, lambda w: F.regexp_like("p_type", F.concat(F.lit(r"(?i)\b"), w, F.lit(r"\b"))))
    return table(spark, d, "part").select("p_partkey", F.when(F.size(found) > 0, found).alias("routed"))


_ASK = f"""ch AS (SELECT doc_id AS key, source AS filing, lang AS st, lang || ' ' || text AS text, embedding FROM documents JOIN embeddings ON doc_id = vec_id),
qs AS (SELECT item_id AS question_id, text, embedding, CASE item_id // {EVERY} % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['src1'] WHEN 2 THEN ['src0', 'src2', 'src3'] ELSE ['src2', 'src4'] END AS filings, CASE WHEN item_id // {EVERY} % 3 = 1 THEN 'en' END AS st FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % {EVERY} = 0),
asks AS (SELECT question_id, text, embedding, st, greatest(len(filings), 1) AS n, unnest(CASE WHEN len(filings) = 0 THEN [NULL] ELSE filings END) AS filing, unnest(range(greatest(len(filings), 1))) AS place FROM qs),
pairs AS (SELECT a.question_id, a.place, c.key, c.st = a.st AS boosted, {_DIST.replace('c.embedding', 'c.embedding').replace('q.embedding', 'a.embedding')} AS distance FROM asks a, ch c WHERE a.filing IS NULL OR a.filing = c.filing),
sem AS (SELECT *, row_number() OVER (PARTITION BY question_id, place ORDER BY distance, key) AS rank FROM pairs), boost AS (SELECT *, row_number() OVER (PARTITION BY question_id, place ORDER BY distance, key) AS rank FROM pairs WHERE boosted),
terms AS (SELECT DISTINCT question_id, w AS term FROM (SELECT question_id, unnest({_WORDS.format('text')}) AS w FROM qs) WHERE w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '(19|20)[0-9][0-9]')),
lens AS (SELECT key, len({_WORDS.format('text')}) AS length FROM ch), stats AS (SELECT count(*) AS n, avg(length) AS mean FROM lens),
tf AS (SELECT term, key, count(*) AS tf FROM (SELECT key, unnest({_WORDS.format('text')}) AS term FROM ch) WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT question_id, key, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM tf JOIN df USING (term) JOIN lens USING (key) JOIN terms USING (term), stats GROUP BY ALL),
kws AS (SELECT a.question_id, a.place, bm.key, row_number() OVER (PARTITION BY a.question_id, a.place ORDER BY score DESC, bm.key) AS rank FROM asks a JOIN bm USING (question_id) JOIN ch ON ch.key = bm.key WHERE a.filing IS NULL OR a.filing = ch.filing),
u AS (SELECT question_id, place, key, max(rank) FILTER (l = 0) AS r0, max(rank) FILTER (l = 1) AS r1, max(rank) FILTER (l = 2) AS r2 FROM (SELECT question_id, place, key, rank, 0 AS l FROM sem WHERE rank <= {R.DEPTH} UNION ALL SELECT question_id, place, key, rank, 1 FROM kws WHERE rank <= {R.DEPTH} UNION ALL SELECT question_id, place, key, rank, 2 FROM boost WHERE rank <= {R.DEPTH}) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id, place ORDER BY 0.0::DOUBLE + coalesce(1.0::DOUBLE / (60 + r0), 0.0) + coalesce(1.0::DOUBLE / (60 + r1), 0.0) + coalesce(1.0::DOUBLE / (60 + r2), 0.0) DESC, coalesce(r0, 1000000 + r1, 2000000 + r2)) AS rank FROM u),
o AS (SELECT f.question_id, a.filing, f.key, f.rank, row_number() OVER (PARTITION BY f.question_id ORDER BY f.rank, f.place) AS result FROM f JOIN asks a USING (question_id, place) WHERE f.rank <= ceil({TOP} / a.n))"""


def _ask(spark, d) -> tuple[DataFrame, DataFrame]:
    v, docs, number = table(spark, d, "embeddings"), table(spark, d, "documents"), F.floor(F.col("item_id") / EVERY)
    chunks = docs.join(v, F.col("doc_id") == F.col("vec_id")).select(F.col("doc_id").alias("key"), F.col("source").alias("filing"), F.col("lang").alias("statement_type"), F.col("lang").alias("heading"), F.col("text").alias("content"), F.col("embedding").alias("v"))
    texts = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    filings = F.when(number % 4 == 0, texts()).when(number % 4 == 1, texts("src1")).when(number % 4 == 2, texts("src0", "src2", "src3")).otherwise(texts("src2", "src4"))
    asked = table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0).join(v, F.col("item_id") == F.col("vec_id"))
    return asked.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.col("embedding").alias("q"), filings.alias("filings"), F.when(number % 3 == 1, "en").alias("statement_type")), chunks


@query("ask_retrieval", f"WITH {_ASK} SELECT question_id, CAST(result AS INTEGER) AS result, filing, key, CAST(rank AS INTEGER) AS rank FROM o WHERE result <= {TOP}")
def ask_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The results of every question, each with filters of its own: no company, one or several, with or without a statement."""
    return A.retrieve(*_ask(spark, d), TOP).select("question_id", "result", "filing", "key", "rank")


@query("ask_prompts", f"""WITH {_ASK}, p AS (SELECT o.question_id, sum(len({_WORDS.format("'--- Excerpt from ' || ch.filing || ', section ' || ch.st || ' --- ' || substr(ch.text, length(ch.st) + 2)")})) AS t, count(*) AS n FROM o JOIN ch USING (key) WHERE result <= 5 GROUP BY 1),
z AS (SELECT q.question_id, coalesce(p.n, 0) AS excerpts, coalesce(p.t, 0) + 10 + 3 + len({_WORDS.format('q.text')}) AS tokens, {' OR '.join(f"contains(lower(q.text), '{w}')" for w in T.SYNTHESIS)} AS synthesis FROM qs q LEFT JOIN p USING (question_id))
SELECT question_id, CAST(excerpts AS BIGINT) AS excerpts, CAST(tokens AS BIGINT) AS tokens, CASE WHEN synthesis THEN 'synthesis' ELSE 'lookup' END AS effort, CASE WHEN excerpts = 0 THEN 'no excerpts' WHEN tokens > 4000 THEN 'prompt too long' END AS refusal FROM z""")
def ask_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What would go to the model, counted in words, and the questions that are refused."""
    found = A.ask(*_ask(spark, d), "Answer only from the excerpts. Name the filing.\nState units.", TOP, 5, 4000, count=lambda c: F.size(T.words(c)))
    return found.select("question_id", F.col("excerpts").cast("long").alias("excerpts"), F.col("tokens").cast("long").alias("tokens"), "effort", "refusal")
