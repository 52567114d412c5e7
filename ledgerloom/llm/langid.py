"""Language identification by rank-order profiles of character n-grams.

Texts are lower-cased and every run of non-letters becomes one space. A profile holds the most
frequent n-grams of one to three characters in the order of their frequency; ties go to the smaller
n-gram. The distance of a document to a language is the sum, over the document's own most frequent
n-grams, of how far each is from its place in the language's profile, an absent one counting as far
as can be. The nearest language wins, ties to the smaller name.

Profiles count every n-gram of every labelled document; they are summed per task, then per language.
What reaches the driver is `size` rows for each language.

Defined results: null text and text without a letter give `und` with score 0, as does everything
when nothing is labelled; null labels are not learned from; repeated rows count each time. The score
is 1 - distance / largest possible distance. An empty table gives no rows; very long texts are profiled
whole; ties between n-grams go to the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import slices

SIZE, UNKNOWN = 300, "und"
_SPACE = 32
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> np.ndarray:
    """Every n-gram of a text as one number: 21 bits a character, so longer n-grams are larger."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letter_table()[c]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, c, _SPACE)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of non-letters the first
    c = np.concatenate([[_SPACE], c[keep], [_SPACE]])
    if c[1] == _SPACE:
        c = c[1:]
    if c[-2] == _SPACE:
        c = c[:-1]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    return np.concatenate([c[c != _SPACE], two, three])


def ranked(counts: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The values by descending count, ties by value (values ascend), at most `size`."""
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        at = np.flatnonzero(counts >= least)
        counts, values = counts[at], values[at]
    return values[np.argsort(-counts, kind="stable")][:size]


def learn(docs: DataFrame, text_column: str = "text", label_column: str = "lang", size: int = SIZE) -> DataFrame:
    """(lang, gram, place): the profile of each language, place from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting = 0

        def fold() -> None:
            for lang, parts in held.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    old, m = sums[lang]
                    both, at = np.unique(np.concatenate([old, values]), return_inverse=True)
                    values, n = both, np.bincount(at, np.concatenate([m, n])).astype(np.int64)
                sums[lang] = values, n
            held.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (values, n) in sums.items():
                for k in range(0, len(values), 50_000):
                    part = values[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[k : k + 50_000], pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        for whole in batches:
            for batch in slices(whole, "t"):
                for text, lang in zip(batch.column("t").to_pylist(), batch.column("l").to_pylist(), strict=True):
                    if len(g := grams(text)):
                        held.setdefault(lang, []).append(g)
                        waiting += len(g)
                if waiting > 2_000_000:
                    fold()
                    waiting = 0
                    if sum(len(v) for v, _ in sums.values()) > 500_000:  # what a task holds is bounded
                        yield from out()
        fold()
        yield from out()

    labelled = docs.where(F.col(text_column).isNotNull() & F.col(label_column).isNotNull()).select(F.col(text_column).alias("t"), F.col(label_column).cast("string").alias("l"))
    counts = labelled.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", (F.col("place") - 1).alias("place"))


class Profiles:
    """Profiles side by side: for each n-gram that any language has, its place in every language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = SIZE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, gram), column[lang]] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text and self.langs else ()
        if not len(g):
            return UNKNOWN, 0.0
        values, counts = np.unique(g, return_counts=True)
        own = ranked(counts, values, self.size)
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        places = self.places[np.where(known, at, len(self.grams))]
        far = np.where(places < 0, self.size, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(np.argmin(far))
        return self.langs[best], 1.0 - float(far[best]) / (self.size * len(own))


def identify(docs: DataFrame, train: Column, text_column: str = "text", label_column: str = "lang", keep: tuple[str, ...] = ("doc_id",), size: int = SIZE) -> DataFrame:
    """The kept columns with lang_pred and score for every row; profiles come from the rows where `train` holds."""
    profiles = Profiles([tuple(r) for r in learn(docs.where(train), text_column, label_column, size).collect()], size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                found = [profiles.predict(t) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*own, "lang_pred", "score"])

    own = [f"_k{i}" for i in range(len(keep))]
    text = own[keep.index(text_column)] if text_column in keep else "_t"  # a text that is kept is sent once
    plain = docs.select(*(F.col(c).alias(o) for c, o in zip(keep, own, strict=True)), *[F.col(text_column).alias("_t")] * (text == "_t"))
    schema = T.StructType([*(T.StructField(o, docs.schema[c].dataType) for o, c in zip(own, keep, strict=True)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema).withColumnsRenamed(dict(zip(own, keep, strict=True)))
