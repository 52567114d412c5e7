"""The ask flow over many questions at once: one plan in which each question has filters of its own.

A question is asked once for each company that it names, or once without a filter. Each of these asks has up to three
ranked lists (vectors, keywords over heading and content, vectors within the statement that the question
names), which are fused; the asks of one question are interleaved, the first of each company first. What
cannot be asked is a row with its reason, so that one question never stops the others.

Defined results: null filings are none; a question without terms has no keyword list; questions that are repeated
under one id are one; a question without excerpts, or whose prompt is over the limit, is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import retrieval as R


def asks(questions: DataFrame) -> DataFrame:
    """(question_id, ask, place, filing, n, statement_type, q) of questions (question_id, q, filings, statement_type); ask numbers what is searched."""
    own = questions.dropDuplicates(["question_id"]).withColumn("_f", F.when(F.size("filings") > 0, F.array_sort(F.array_distinct("filings"))).otherwise(F.array(F.lit(None).cast("string"))))
    spread = own.select("question_id", F.size("_f").alias("n"), "statement_type", "q", F.posexplode("_f").alias("place", "filing"))
    return spread.withColumn("ask", F.xxhash64("question_id", "place"))


def retrieve(questions: DataFrame, chunks: DataFrame, k: int, depth: int = R.DEPTH, split: Callable[[Column], Column] = T.words, names: Column | None = None) -> DataFrame:
    """(question_id, result, filing, place, key, rank): the k results of each of questions (question_id, question, q, filings, statement_type).

    chunks are (key, filing, statement_type, heading, content, v); `split` makes the terms of chunks, and of what
    is left of a question without stop words, years and `names`.
    """
    asked = asks(questions)
    searched = asked.select(F.col("ask").alias("question_id"), "q", "filing", "statement_type")
    vectors = chunks.select("key", "v", F.col("filing").alias("of"), F.col("statement_type").alias("kind"))
    semantic = R.vector_topk(searched, vectors, depth, same=(("filing", "of"),), open_ended=True)
    boost = R.vector_topk(searched.where("statement_type is not null"), vectors, depth, same=(("filing", "of"), ("statement_type", "kind")), open_ended=True)
    bodies = chunks.select("key", F.concat_ws(" ", "heading", "content").alias("body"))
    plain = questions.dropDuplicates(["question_id"]).select("question_id", F.array_join(T.keyword_terms(F.col("question"), names), " ").alias("t"))
    terms = plain.select("question_id", F.explode(F.array_distinct(split(F.col("t")))).alias("term")).join(asked.select("question_id", "ask"), "question_id").select(F.col("ask").alias("question_id"), "term")
    filters = asked.select(F.col("ask").alias("question_id"), "filing")
    held = chunks.select("key", F.col("filing").alias("of"))
    keep = lambda scored: scored.join(filters, "question_id").join(held, "key").where("filing is null or filing = of")
    keyword = R.bm25(terms, R.postings(bodies, "key", "body", split, terms), R.lengths(bodies, "key", "body", split), depth, keep=keep)
    fused = R.fuse([x.select("question_id", "key", "rank") for x in (semantic, keyword, boost)], k).withColumnRenamed("question_id", "ask")
    own = fused.join(asked.select("ask", "question_id", "place", "filing", "n"), "ask").where(F.col("rank") <= F.ceil(F.lit(k) / F.col("n")))
    return R.top(own, "question_id", [F.col("rank"), F.col("place")], k, "result").select("question_id", "result", "filing", "place", "key", "rank")


def ask(questions: DataFrame, chunks: DataFrame, system: str, k: int, excerpts: int, limit: int, count: Callable[[Column], Column], **how) -> DataFrame:
    """(question_id, system, user, excerpts, tokens, effort, refusal): the prompt of each question from its first results, or why there is none."""
    found = retrieve(questions, chunks, k, **how).where(F.col("result") <= excerpts)
    own = questions.dropDuplicates(["question_id"]).select("question_id", "question")
    parts = found.select("question_id", "result", "key").join(chunks.select("key", F.col("filing").alias("filing"), "heading", "content"), "key").join(own, "question_id").withColumnRenamed("result", "rank")
    prompts = R.prompt(parts, system).join(parts.groupBy("question_id").agg(F.count(F.lit(1)).alias("excerpts")), "question_id")
    every = own.join(prompts, "question_id", "left").withColumn("excerpts", F.coalesce("excerpts", F.lit(0)))
    lines = F.lit("\r\n".join(system.splitlines()))
    user = F.coalesce("user", F.concat(F.lit("Context excerpts:\n\n\nQuestion: "), F.coalesce("question", F.lit(""))))
    every = every.withColumn("tokens", count(lines) + count(user))
    refusal = F.when(F.col("excerpts") == 0, "no excerpts").when(F.col("tokens") > limit, "prompt too long")
    effort = F.when(F.coalesce(T.needs_synthesis(F.col("question")), F.lit(False)), "synthesis").otherwise("lookup")
    return every.select("question_id", lines.alias("system"), F.when(refusal.isNull(), F.col("user")).alias("user"), "excerpts", "tokens", effort.alias("effort"), refusal.alias("refusal"))
