"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, fingerprint, langid, lloyd, minhash, negatives, packing, secrets, sharding, simhash, topk, toxicity, warc
from ledgerloom.storage import table

SHARDS = 24


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "range_at")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = {"size": (F.octet_length(text) + 8).cast("long"), "text_crc32": F.crc32(text.cast("binary"))}
    found = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", [1.0] * SHARDS, 1.0, carried)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    found = langid.identify(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = {f"n_{k}": F.expr(f"cast(size(filter(_spans, x -> x.kind = {i})) as long)") for i, k in enumerate(secrets.KINDS[:3])}
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), F.sha2(secrets.written(most=3), 256).alias("base_sha256"), secrets.written().alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_links(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = lloyd.encode(table(spark, sf_dir, "embeddings"))
    written = F.lower(F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return lloyd.with_label_errors(codes).select("vec_id", written.alias("code"), "error", "label_error", F.lit(lloyd.sha256(books)).alias("codebooks_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_warc, op3_sharding, op4_langid, op5_fingerprint, op6_packing, op7_secrets, op8_toxicity, op9_topk, op10_simhash, op11_minhash, op12_negatives, op13_codes)
}

_OP9 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, least(len(q.w), len(c.w)) + 1)]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_VECTORS = """SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

_OP12 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, w FROM ({_VECTORS}) WHERE vec_id IS NOT NULL AND label IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum([a.w[i] * b.w[i] FOR i IN range(1, least(len(a.w), len(b.w)) + 1)]) AS BIGINT) AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

_ASSIGNED = """SELECT vec_id, label, k.p, k.x, min(list_sum([0] || [(k.x[i] - c.x[i]) * (k.x[i] - c.x[i]) FOR i IN range(1, len(k.x) + 1)]) * 64 + c.e) AS near
  FROM parts k JOIN {books} c ON k.p = c.p GROUP BY ALL"""
_UPDATED = """SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM {books} c LEFT JOIN (
  SELECT p, e, list(v ORDER BY i) AS x FROM (
    SELECT p, near % 64 AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS v FROM {assigned}, range(1, 1 + (SELECT max(len(x)) FROM parts)) AS t(i) GROUP BY ALL) GROUP BY ALL) m
  ON c.p = m.p AND c.e = m.e"""
#: For a table whose vectors have one length, which 16 divides, and ids without repeats.
_OP13 = f"""
WITH parts AS (SELECT vec_id, label, p, w[p * (len(w) // 16) + 1 : (p + 1) * (len(w) // 16)] AS x FROM ({_VECTORS}), range(16) AS r(p)),
books0 AS (SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= 64),
assigned0 AS ({_ASSIGNED.format(books="books0")}), books1 AS ({_UPDATED.format(books="books0", assigned="assigned0")}),
assigned1 AS ({_ASSIGNED.format(books="books1")}), books2 AS ({_UPDATED.format(books="books1", assigned="assigned1")}),
assigned2 AS ({_ASSIGNED.format(books="books2")}),
codes AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(near % 64 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(near // 64) AS BIGINT) AS error FROM assigned2 GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM books2) AS codebooks_sha256 FROM codes
"""

ORACLE_SQL = {"op9_topk": _OP9, "op12_negatives": _OP12, "op13_codes": _OP13}
