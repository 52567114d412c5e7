"""Retrieval: exact vector top-k, BM25 over postings, rank fusion, routing, reranking, prompts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import words
from ledgerloom.storage import cut

RRF_K, DEPTH, K1, B = 60, 50, 1.2, 0.75


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a| |b|) in double, null for vectors without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top(df: DataFrame, by: str, order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """Ranks from 1 within each group, down to k; Spark cuts groups before the exchange."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(out) <= k)


#: Chunks and questions of a block, and numbers of scores that a task holds at a time.
GROUP, BATCH, AT_ONCE = 16_384, 1024, 1 << 20


def _vectors(df: DataFrame, vector: str, columns: dict[str, str | Column], blocks: int, salt: int, other: tuple[str, int]) -> DataFrame:
    """The rows with a vector of finite numbers, in a block of their own kind and once for each block of the other."""
    v = F.col(vector)
    finite = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = df.where(finite).select(*(F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()), F.transform(v, lambda x: x.cast("double")).alias("w"))
    name = "b" if other[0] == "g" else "g"
    return own.withColumn(name, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int")).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))))


def vector_topk(questions: DataFrame, chunks: DataFrame, k: int, same: tuple[tuple[str, str], ...] = (), by: str | None = None, open_ended: bool = False, group: int = GROUP, batch: int = BATCH) -> DataFrame:
    """(question_id, key, distance, rank) by cosine distance from questions (question_id, q) and chunks (key, v).

    Both sides fall into blocks; a task holds one of each, so neither is sent whole to every task, and sends on the k
    best of each question. `same` names pairs of a question's and a chunk's column that have to be equal, where with `open_ended`
    a question's null is no condition; with `by`, a column of chunks, k are found for each of its values, which comes along. Vectors that are null, hold null or a
    non-finite number, or have no length take no part, nor do pairs of different lengths; ties go to the smaller key.
    """
    groups, batches = max(1, -(-chunks.count() // group)), max(1, -(-questions.count() // batch))
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    tag = lambda side: F.array(*(text(pair[side]) for pair in same)).cast("array<string>")
    left = _vectors(questions, "q", {"id": "question_id", "tag": tag(0)}, batches, 1, ("g", groups))
    right = _vectors(chunks, "v", {"id": "key", "tag": tag(1), "of": text(by) if by else none}, groups, 2, ("b", batches))
    schema = pa.schema([("question_id", pa.int64()), ("key", pa.int64()), ("of", pa.string()), ("distance", pa.float64())])

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if q.num_rows and c.num_rows:
            sizes = [np.asarray(pc.list_value_length(t["w"].combine_chunks())) for t in (q, c)]
            tags = [np.array([tuple(x) for x in t["tag"].to_pylist()] or [()], object).reshape(t.num_rows, len(same)) for t in (q, c)]
            of = np.array(c["of"].to_pylist(), object)
            for size in set(sizes[0].tolist()) & set(sizes[1].tolist()) - {0}:
                at = [np.flatnonzero(s == size) for s in sizes]
                x, y = (np.asarray(t["w"].take(i).combine_chunks().flatten(), np.float64).reshape(-1, size) for t, i in zip((q, c), at, strict=True))
                ids, keys = (np.asarray(t["id"])[i] for t, i in zip((q, c), at, strict=True))
                kinds = of[at[1]]
                parts = [np.flatnonzero(kinds == o) for o in set(kinds)] if by else [np.arange(len(keys))]
                lengths = [np.sqrt((m * m).sum(1)) for m in (x, y)]
                step = max(1, AT_ONCE // len(keys))
                for low in range(0, len(ids), step):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        far = 1 - (x[low : low + step] @ y.T) / (lengths[0][low : low + step, None] * lengths[1][None, :])
                    for n, row in enumerate(far):
                        fits = np.isfinite(row)
                        for column, wanted in enumerate(tags[0][at[0][low + n]]):
                            if wanted is not None:
                                fits &= tags[1][at[1], column] == wanted
                            elif not open_ended:
                                fits &= False
                        for part in parts:
                            own = part[fits[part]]
                            near = np.round(row[own], 9)
                            if len(own) > k:
                                own = own[near <= np.partition(near, k - 1)[k - 1]]
                            own = own[np.lexsort((keys[own], np.round(row[own], 9)))[:k]]
                            for column, values in zip(out, ([int(ids[low + n])] * len(own), keys[own].tolist(), kinds[own].tolist(), row[own].tolist()), strict=True):
                                column += values
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    best = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, "question_id long, key long, of string, distance double").withColumn("distance", F.round("distance", 9))
    if by is None:
        return top(best, "question_id", [F.col("distance"), F.col("key")], k).select("question_id", "key", "distance", "rank")
    kind = chunks.schema[by].dataType
    each = top(best.withColumn("_each", F.struct("question_id", "of")), "_each", [F.col("distance"), F.col("key")], k)
    return each.select("question_id", F.col("of").cast(kind).alias(by), "key", "distance", "rank")


def postings(chunks: DataFrame, key: str, text: str, split: Callable[[Column], Column] = words, only: DataFrame | None = None) -> DataFrame:
    """(term, key, tf). `split` makes the terms of a text; questions have to be split alike. With `only` (term), which is broadcast, other terms go before anything is counted or shuffled."""
    each = chunks.select(F.col(key).alias("key"), F.explode(split(F.col(text))).alias("term"))
    if only is not None:
        each = each.join(F.broadcast(only.select("term").distinct()), "term")
    return each.groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf"))


def lengths(chunks: DataFrame, key: str, text: str, split: Callable[[Column], Column] = words) -> DataFrame:
    return chunks.select(F.col(key).alias("key"), F.size(split(F.col(text))).cast("long").alias("length"))


def bm25(questions: DataFrame, index: DataFrame, sizes: DataFrame, k: int, allowed: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(question_id, key, score, rank). questions (question_id, term). Statistics are of all chunks; `allowed` (key, and question_id if it depends on the question) filters afterwards, as does `keep`.

    Postings of the asked terms and lengths are written to the shared folder: statistics and scores read them there, so each text is split once for either.
    """
    sizes = cut(sizes, "lengths")
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    asked = questions.distinct()
    hits = cut(index.join(F.broadcast(asked.select("term").distinct()), "term"), "postings")  # terms of a bounded batch of questions
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = hits.join(F.broadcast(df), "term").join(sizes, "key").join(F.broadcast(total)).join(F.broadcast(asked), "term")
    summed = scored.groupBy("question_id", "key").agg(F.round(F.sum(weight), 9).alias("score"))
    if allowed is not None:
        summed = summed.join(allowed, [c for c in ("question_id", "key") if c in allowed.columns], "left_semi")
    if keep is not None:
        summed = keep(summed)
    return top(summed, "question_id", [F.col("score").desc(), F.col("key")], k).select("question_id", "key", "score", "rank")


def fuse(lists: list[DataFrame], k: int, c: int = RRF_K) -> DataFrame:
    """(question_id, key, score, rank) by reciprocal ranks of lists (question_id, key, rank).

    Terms are added in the order of the lists; ties keep the order in which a key is first seen.
    """
    named = [x.groupBy("question_id", "key").agg(F.min("rank").alias("rank")).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    together = named[0]
    for x in named[1:]:
        together = together.unionByName(x)
    ranks = together.groupBy("question_id", "key").agg(*(F.max(F.when(F.col("list") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))))
    score, seen = F.lit(0.0), F.lit(None)
    for i in range(len(lists)):
        score = score + F.coalesce(1.0 / (c + F.col(f"r{i}")), F.lit(0.0))
    for i in reversed(range(len(lists))):
        seen = F.when(F.col(f"r{i}").isNotNull(), F.lit(float(i) * 1e6) + F.col(f"r{i}")).otherwise(seen)
    fused = ranks.select("question_id", "key", score.alias("score"), seen.alias("_seen"))
    return top(fused, "question_id", [F.col("score").desc(), F.col("_seen")], k).drop("_seen")


def interleave(ranked: DataFrame, k: int) -> DataFrame:
    """ranked (question_id, company, key, rank): A1, B1, A2, B2, ... ; each company gives ceil(k / n)."""
    n = F.count_distinct("company").alias("n")
    sizes = ranked.groupBy("question_id").agg(n)
    own = ranked.join(sizes, "question_id").where(F.col("rank") <= F.ceil(F.lit(k) / F.col("n")))
    return top(own, "question_id", [F.col("rank"), F.col("company")], k, "place").select("question_id", "company", "key", "rank", "place")


def rerank(candidates: DataFrame, k: int, depth: int) -> DataFrame:
    """candidates (question_id, key, rank, relevance): the first `depth`, sorted by relevance, ties as before; keeps hybrid_rank."""
    cut = candidates.where(F.col("rank") <= max(k, depth)).withColumnRenamed("rank", "hybrid_rank")
    return top(cut, "question_id", [F.col("relevance").desc(), F.col("hybrid_rank")], k)


def prompt(excerpts: DataFrame, system: str) -> DataFrame:
    """excerpts (question_id, rank, filing, heading, content, question): one prompt a question, excerpts in order.

    The system prompt's line breaks become CRLF, whatever they are in the source. Labels are not numbered.
    """
    block = F.concat(F.lit("--- Excerpt from "), F.col("filing"), F.lit(", section "), F.col("heading"), F.lit(" ---\n"), F.col("content"), F.lit("\n\n"))
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("t"))))
    joined = excerpts.groupBy("question_id").agg(F.first("question").alias("question"), F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("body"))
    user = F.concat(F.lit("Context excerpts:\n\n"), F.col("body"), F.lit("\nQuestion: "), F.col("question"))
    return joined.select("question_id", F.lit("\r\n".join(system.splitlines())).alias("system"), user.alias("user"))


def rerank_passage(context: Column, filing: Column, heading: Column, content: Column) -> Column:
    """What a reranker reads of a chunk: its company line if there is one, the excerpt's place, the chunk."""
    return F.concat_ws("\n", context, F.concat(F.lit("Excerpt from "), filing, F.lit(", section "), heading), content)


def largest_prompt(chunks: DataFrame, tokens: str, k: int, system_tokens: int, spare: int = 100) -> DataFrame:
    """Tokens of the k longest chunks, the system prompt and some to spare."""
    longest = chunks.select(F.col(tokens).alias("t")).orderBy(F.col("t").desc()).limit(k)
    return longest.agg((F.coalesce(F.sum("t"), F.lit(0)) + system_tokens + spare).alias("tokens"))


def blend(fused: DataFrame, kind: int) -> DataFrame:
    """fused (question_id, key, score, hybrid_rank, rerank_rank): 2 fuses both orders, 4 adds the reranker's to the fused score."""
    second = 1.0 / (RRF_K + F.col("rerank_rank"))
    value = {2: 1.0 / (RRF_K + F.col("hybrid_rank")) + second, 4: F.col("score") + second}[kind]
    return fused.withColumn("blended", value)


def weighted_fusion(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """scored (question_id, key, a column for each weight): the weighted sum of scores scaled to 0..1 within a question; a missing score is 0."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.coalesce(min_max(name, "question_id"), F.lit(0.0)) * weight
    return scored.withColumn("fused", total)


def min_max(value: str, by: str) -> Column:
    w = Window.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
