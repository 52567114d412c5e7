"""Document fingerprints by consistent weighted sampling.

Terms are the lower-cased words of a text, weighted by how often they occur. For each of K samples
a term draws r and c from Gamma(2, 1) and b uniformly, all from a hash of term and sample; with
t = floor(ln w / r + b) and ln y = r (t - b) the term scores ln c - ln y - r, and the term with the
least score is the sample, together with its t. Two texts agree on a sample with a probability that
equals their generalised Jaccard similarity, sum of min weights over sum of max weights; their
likeness is the share of samples that agree. A sample is kept as 16 bits of a hash of term and t.

The draws of a term are kept in a bounded table per Python worker, as they take most of the time.

Defined results: null text is empty; a text without a word has only zero samples (and likeness 1
with another such text); equal texts have equal fingerprints.

`with_next` hands each text to its predecessor by id in one exchange by ranges of the id, in which
the first text of each range also goes to the range before. Null ids come first, repeated ids by
their text's hash; a single row is its own next.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import slices

SAMPLES, TERMS_KEPT = 64, 60_000
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Sampler:
    """Draws of terms, a row of a table each; the table starts anew when it is full."""

    def __init__(self, samples: int = SAMPLES, kept: int = TERMS_KEPT):
        self.k, self.kept = samples, kept
        self.salts = _mix(np.arange(1, 3 * samples + 1, dtype=np.uint64) * _STEP).reshape(3, 1, samples)
        self.rows: dict[str, int] = {}
        self.hash = np.zeros(kept, np.uint64)
        self.r, self.b, self.c, self.one = (np.zeros((kept, samples), np.float32) for _ in range(4))

    def _draw(self, terms: list[str], start: int) -> None:
        import xxhash

        h = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 7) for t in terms], np.uint64)
        # 64 bits give two uniforms, so three hashes are enough for two Gammas and b.
        x = _mix(h[None, :, None] ^ self.salts)
        high = ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
        low = ((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-32)
        r = np.maximum(-np.log(high[0]) - np.log(low[0]), np.float32(1e-6))
        c = np.log(np.maximum(-np.log(high[1]) - np.log(low[1]), np.float32(1e-6)))
        b = np.minimum(high[2], np.float32(1 - 2**-24))
        at = slice(start, start + len(terms))
        self.hash[at], self.r[at], self.b[at], self.c[at] = h, r, b, c
        self.one[at] = c + r * b - r  # the score at weight 1, where t is 0

    def _places(self, terms: list[str]) -> np.ndarray:
        missing = [t for t in terms if t not in self.rows]
        if missing and len(self.rows) + len(missing) > self.kept:
            self.rows.clear()
            missing = terms
        if missing:
            start = len(self.rows)
            self._draw(missing, start)
            self.rows.update(zip(missing, range(start, start + len(missing)), strict=True))
        return np.array([self.rows[t] for t in terms], np.int64)

    def _best(self, terms: list[str], weights: np.ndarray):
        at = self._places(terms)
        score, t = self.one[at], np.zeros((len(at), self.k), np.float32)
        if len(more := np.flatnonzero(weights > 1)):
            a = at[more]
            r, b = self.r[a], self.b[a]
            t[more] = np.floor(np.log(weights[more], dtype=np.float32)[:, None] / r + b)
            score[more] = self.c[a] - r * (t[more] - b) - r
        pick, cols = score.argmin(0), np.arange(self.k)
        return score[pick, cols], self.hash[at[pick]], t[pick, cols]

    def samples(self, text: str) -> np.ndarray:
        counts = Counter(text.lower().split())
        if not counts:
            return np.zeros(self.k, np.uint16)
        terms = sorted(counts)  # ties, which are all but impossible, go to the smaller term
        weights = np.array([counts[t] for t in terms], np.float64)
        best = None
        for k in range(0, len(terms), self.kept):  # a text may hold more terms than the table
            part = self._best(terms[k : k + self.kept], weights[k : k + self.kept])
            if best is None:
                best = part
            else:
                less = part[0] < best[0]
                best = tuple(np.where(less, p, q) for p, q in zip(part, best, strict=True))
        _, h, t = best
        return np.maximum(_mix(h + t.astype(np.int64).astype(np.uint64) * _STEP) >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def hexed(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """Text with its last floor(n / 2) characters replaced by the first as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_samplers: dict[int, Sampler] = {}


def sampler(samples: int) -> Sampler:
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def with_next(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(part, ord, row, kind, i, t): docs in order within each part; kind 1 is a copy of what follows the part."""
    plain = docs.select(F.col(id_column).cast("long").alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    spark = docs.sparkSession
    ids = plain.select("i").where(F.col("i").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(ids.approxQuantile("i", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    # A range starts after its bound; a null id is in the first range.
    part = F.coalesce(F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: F.col("i") > b)), F.lit(0)) if bounds else F.lit(0)
    ranged = plain.withColumn("part", part.cast("int"))
    # The first id of each range: one row for each range, as many as there are tasks.
    heads = [(r["part"], r["head"]) for r in ranged.groupBy("part").agg(F.min(F.struct(F.col("i").isNotNull().alias("some"), F.col("i"))).alias("h")).select("part", F.col("h.i").alias("head")).collect()]
    if not heads:
        return ranged.select("part", F.lit(0).alias("kind"), "i", "t")
    heads.sort()
    before = {p: heads[k - 1][0] for k, (p, _) in enumerate(heads)}  # the last range comes before the first
    lookup = spark.createDataFrame([(p, h, before[p]) for p, h in heads], "part int, head long, to int")
    own, copy = (F.struct(F.col(c).alias("part"), F.lit(k).alias("kind")) for c, k in (("part", 0), ("to", 1)))
    places = F.when(F.col("i").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))
    dealt = ranged.join(F.broadcast(lookup), "part").select(F.explode(places).alias("p"), "i", "t").select("p.part", "p.kind", "i", "t")
    return dealt.repartition(max(parts, len(heads)), "part").sortWithinPartitions("part", "kind", F.col("i").asc_nulls_first(), F.xxhash64("t"))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every document."""
    names = ["i", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, rows = sampler(samples), None, []

        def row(a, b) -> tuple:
            changed = edited(a[2], b[2])
            x = own.samples(changed)
            return a[1], len(a[2]), hashlib.sha256(changed.encode()).hexdigest(), hexed(a[3]), hexed(x), likeness(a[3], x), likeness(a[3], b[3])

        for whole in batches:
            for batch in slices(whole, "t"):
                for part, kind, i, t in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "i", "t")), strict=True):
                    if kind and held is None:  # further rows that share the id of what follows the part
                        continue
                    now = (part, i, t, own.samples(t))
                    if held is not None:
                        rows.append(row(held, now))
                    held = None if kind else now
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows.clear()

    schema = "i long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_column, text_column).mapInArrow(run, schema).withColumnRenamed("i", id_column)
