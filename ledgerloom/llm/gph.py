"""Generalised pigeonhole search in Hamming space: which bits form a part, and what each part may differ by.

Bits are dealt into m parts. If two fingerprints differ in at most `radius` bits, then for thresholds
T with sum radius - m + 1 they differ in at most T_i bits of some part i; -1 means that a part is not
searched. Bits that correlate go into the same part, so that the other parts stay selective, and the
thresholds are chosen by dynamic programming over what each is estimated to cost: the keys that it
probes and the candidates that it finds. Estimates come from bit counts over all fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    word: int
    bits: tuple[int, ...]
    threshold: int


def bit_counts(fingerprints: DataFrame, words: list[str]) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each word how many have bits i and j both (64 x 64)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((len(words), 64, 64), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for k, w in enumerate(words):
                values = np.asarray(batch.column(w)).astype("<i8")
                for low in range(0, len(values), 65_536):
                    bits = np.unpackbits(values[low : low + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                    sums[k] += (bits.T @ bits).astype(np.int64)
        own = pa.array([sums.ravel().tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([rows], pa.int64()), own], ["bucket", "rows", "sums"])

    def add(table: pa.Table) -> pa.Table:
        lists = table["sums"].combine_chunks()
        total = np.asarray(lists.flatten()).reshape(len(lists), -1).sum(0)
        return pa.table({"bucket": pa.array([0], pa.int32()), "rows": pa.array([int(np.asarray(table["rows"]).sum())], pa.int64()), "sums": pa.array([total.tolist()], pa.list_(pa.int64()))})

    schema = "bucket int, rows long, sums array<long>"
    partial = fingerprints.select(*words).mapInArrow(count, schema).groupBy("bucket").applyInArrow(add, schema)
    found = partial.collect()  # 64 rows at most
    n = sum(r["rows"] for r in found)
    sums = sum((np.array(r["sums"]) for r in found), np.zeros(len(words) * 4096)).reshape(len(words), 64, 64)
    return n, sums


def correlated(n: int, sums: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """64 bits in m parts of near-equal width; each part grows by the bit that correlates most with it."""
    if not n:
        return [tuple(int(b) for b in p) for p in np.array_split(np.arange(64), m)]
    p = np.diag(sums) / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((sums / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, parts = set(range(64)), []
    for k in range(m):
        width = len(np.array_split(np.arange(64), m)[k])
        pool = sorted(free)
        start = max(pool, key=lambda b: (tie[b, pool].sum(), -b))
        part = [start]
        free.discard(start)
        while len(part) < width:
            best = max(sorted(free), key=lambda b: (tie[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(tuple(sorted(part)))
    return parts


def costs(n: int, share: np.ndarray, most: int) -> list[float]:
    """Estimated cost of thresholds -1 to most for a part whose bits are set with these shares."""
    differ = 2 * share * (1 - share)
    chance = np.zeros(len(share) + 1)
    chance[0] = 1.0
    for d in differ:  # bits taken as independent: how many of them two fingerprints differ in
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    out, width = [0.0], len(share)
    for t in range(most + 1):
        out.append(n * sum(comb(width, j) for j in range(t + 1)) + n * n / 2 * float(chance[: t + 1].sum()))
    return out


def allocate(table: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1, one for each row of costs, with this sum and the least cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in table:
        after: dict[int, tuple[float, list[int]]] = {}
        for s, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if s + t not in after or cost + c < after[s + t][0]:
                    after[s + t] = cost + c, [*chosen, t]
        best = after
    return best.get(total, (float("inf"), []))


def plan(n: int, sums: np.ndarray, radius: int, widths: range, most: int = 2) -> list[Part]:
    """The parts and thresholds of least estimated cost; widths: numbers of parts of a word to choose from."""
    best = (float("inf"), [])
    for m in widths:
        parts = [(w, bits) for w in range(len(sums)) for bits in correlated(n, sums[w], m)]
        table = [costs(max(n, 2), np.diag(sums[w])[list(bits)] / max(n, 1), most) for w, bits in parts]
        cost, thresholds = allocate(table, radius - len(parts) + 1)
        if thresholds and cost < best[0]:
            best = cost, [Part(w, bits, t) for (w, bits), t in zip(parts, thresholds, strict=True)]
    return best[1]


def key(word: Column, part: Part) -> Column:
    """The part's bits of a fingerprint, put together from 0 up."""
    out = F.lit(0).cast("long")
    for k, b in enumerate(part.bits):
        bit = F.shiftrightunsigned(word, b).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit, k))
    return out


def signed(bits: int) -> Column:
    """A literal of up to 64 bits as a long."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def variants(value: Column, part: Part) -> list[Column]:
    """All keys within the part's threshold of a key."""
    flips, width = [0], len(part.bits)
    for _ in range(part.threshold):
        flips = sorted({f ^ (1 << k) for f in flips for k in range(width)} | set(flips))
    return [value.bitwiseXOR(signed(f)) for f in flips]


def distance(left: list[Column], right: list[Column]) -> Column:
    total = F.lit(0)
    for a, b in zip(left, right, strict=True):
        total = total + F.bit_count(a.bitwiseXOR(b))
    return total


def index(fingerprints: DataFrame, words: list[str], parts: list[Part]) -> DataFrame:
    """(part, key, id, words...): where each fingerprint lies in every part that is searched."""
    entries = F.array(*(F.struct(F.lit(k).alias("part"), key(F.col(words[p.word]), p).alias("key")) for k, p in enumerate(parts) if p.threshold >= 0))
    return fingerprints.select("id", *words, F.explode(entries).alias("e")).select("e.part", "e.key", "id", *words)


def probes(fingerprints: DataFrame, words: list[str], parts: list[Part]) -> DataFrame:
    """(part, key, id, words...): the keys under which each fingerprint looks for others."""
    entries = [F.struct(F.lit(k).alias("part"), v.alias("key")) for k, p in enumerate(parts) if p.threshold >= 0 for v in variants(key(F.col(words[p.word]), p), p)]
    return fingerprints.select("id", *words, F.explode(F.array(*entries)).alias("e")).select("e.part", "e.key", "id", *words)
