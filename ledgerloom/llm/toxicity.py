"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

Grades are ordered: 0 clean, 1 toxic, 2 strongly toxic. P(grade > k) = sigmoid(x w - theta_k) with one
weight vector for all thresholds, theta_1 < theta_2. The expected severity is the sum of those two
probabilities, from 0 to 2. Features are the distinct lower-cased words of a whole text, without
punctuation at their ends. Labels only say toxic or not; a toxic training document has grade 2 if it
holds more than the median number of distinct words that the sample ties to toxic documents.

The model is fitted on a bounded sample: at most `most` labelled documents of each class, those with
the smallest hashes of their id, and of each at most `most_words` distinct words, those with the smallest
hashes. All documents are scored, by all of their words. A document counts as toxic from a probability
on that parts the classes best in `FOLDS` held-out folds of the sample: the largest sum of the shares of
toxic documents caught and of clean ones left alone.

Defined results: null text and text without a word have no feature and get the model's base severity;
null labels and labels of unknown documents are not learned from; without labels of both classes all
severities are 0; repeated rows are scored alike, and of texts that share an id the least is learned from;
a document with both labels is learned from as either; very long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.bpe import slices

MOST, MOST_WORDS, LEAST_DOCS, RIDGE, STEPS, LEAST_Z, FOLDS = 3000, 2048, 4, 1e-3, 400, 3.0, 3
_ENDS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())


def features(text: str | None) -> np.ndarray:
    """Hashes of the distinct words, sorted."""
    import xxhash

    words = {w.strip(_ENDS) for w in (text or "").lower().split()} - {""}
    return np.array(sorted(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11) >> 1 for w in words), np.int64)


@dataclass
class Model:
    """Words with weights, the two thresholds, and the P(grade > 0) from which on a text counts as toxic."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: tuple[float, float] = (50.0, 50.0)
    cut: float = 0.5

    def severity(self, text: str | None) -> tuple[float, float]:
        """(P(grade > 0), P(grade > 1))."""
        return self.chances(features(text) if len(self.words) else ())

    def chances(self, f: np.ndarray) -> tuple[float, float]:
        eta = 0.0
        if len(self.words) and len(f):
            at = np.minimum(np.searchsorted(self.words, f), len(self.words) - 1)
            eta = float(self.weights[at][self.words[at] == f].sum())
        return tuple(1 / (1 + np.exp(-np.clip(eta - t, -60, 60))) for t in self.thresholds)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(docs: list[np.ndarray], toxic: np.ndarray, share: float | None = None, ridge: float = RIDGE, steps: int = STEPS) -> Model:
    """share: of toxic documents among all labelled ones, where the sample's differs."""
    n, ones = len(docs), int(toxic.sum())
    if not ones or ones == n:
        return Model()
    flat, owner = np.concatenate(docs), np.repeat(np.arange(n), [len(d) for d in docs])
    words, column = np.unique(flat, return_inverse=True)
    df = np.bincount(column, minlength=len(words)).astype(float)
    hits = np.bincount(column, toxic[owner], len(words))
    # How far a word's share in toxic documents is from that in clean ones, in standard errors.
    p, q = (hits + 0.5) / (ones + 1), (df - hits + 0.5) / (n - ones + 1)
    z = (np.log(p / (1 - p)) - np.log(q / (1 - q))) / np.sqrt(1 / (hits + 0.5) + 1 / (df - hits + 0.5) + 1 / (ones - hits + 0.5) + 1 / (n - ones - df + hits + 0.5))
    used = (df >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z)
    if not used.any():
        return Model()
    keep = used[column]
    place = np.cumsum(used) - 1
    rows, cols, m = owner[keep], place[column[keep]], int(used.sum())
    strong = np.bincount(rows, (z[used] > 0)[cols], n)
    grade = np.where(toxic, np.where(strong > np.median(strong[toxic.astype(bool)]), 2, 1), 0)
    share = ones / n if share is None else share
    weight = np.where(toxic, share / (ones / n), (1 - share) / (1 - ones / n))

    w, theta, gap = np.zeros(m), 1.0, 0.0  # thresholds theta and theta + exp(gap)
    moments = [np.zeros(m + 2), np.zeros(m + 2)]
    for step in range(1, steps + 1):
        eta = np.bincount(rows, w[cols], n)
        a, b = _sigmoid(eta - theta), _sigmoid(eta - theta - np.exp(gap))
        chance = np.maximum(np.where(grade == 0, 1 - a, np.where(grade == 1, a - b, b)), 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        low = np.where(grade == 0, -da, np.where(grade == 1, da, 0)) / chance * weight  # d log P / d eta by either threshold
        high = np.where(grade == 1, -db, np.where(grade == 2, db, 0)) / chance * weight
        g = np.concatenate([-np.bincount(cols, (low + high)[rows], m) / n + ridge * w, [(low + high).sum() / n], [high.sum() * np.exp(gap) / n]])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, theta, gap = w - move[:m], theta - move[m], gap - move[m + 1]
    return Model(words[used], w, (float(theta), float(theta + np.exp(gap))))


def best_cut(chance: np.ndarray, toxic: np.ndarray, otherwise: float = 0.5) -> float:
    """Half-way between the two chances where toxic documents caught and clean ones left alone are the most, as shares.

    Of several such places the one that leaves most clean ones alone; `otherwise` if none is better than no cut at all.
    """
    order = np.argsort(chance, kind="stable")
    p, y = chance[order], toxic[order].astype(bool)
    if not y.any() or y.all():
        return otherwise
    clean = np.cumsum(~y)[:-1] / (~y).sum()
    caught = 1 - np.cumsum(y)[:-1] / y.sum()
    total = np.where(p[1:] > p[:-1], clean + caught, -1)  # equal chances are on one side
    at = len(total) - 1 - int(np.argmax(total[::-1]))
    return float((p[at] + p[at + 1]) / 2) if total[at] > 1 else otherwise


def fit_with_cut(docs: list[np.ndarray], toxic: np.ndarray, share: float | None = None, folds: int = FOLDS) -> Model:
    """A model of all documents, its cut chosen by models that have not seen what they judge; a text without features stays below it."""
    model = fit(docs, toxic, share)
    if len(model.words):
        fold, chance, seen = np.arange(len(docs)) % folds, np.zeros(len(docs)), np.zeros(len(docs), bool)
        for k in range(folds):
            learned = np.flatnonzero(fold != k)
            other = fit([docs[i] for i in learned], toxic[learned], share)
            if len(other.words):  # a fold too small to learn a word from judges nothing
                held = np.flatnonzero(fold == k)
                chance[held], seen[held] = [other.chances(docs[i])[0] for i in held], True
        base = model.chances(())[0]
        model.cut = max(best_cut(chance[seen], toxic[seen]), base + 1e-9)
    return model


def train(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id", label_column: str = "toxic", most: int = MOST, most_words: int = MOST_WORDS) -> Model:
    known = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).select(F.col(id_column).cast("long").alias("i"), (F.col(label_column) > 0).alias("y")).distinct()
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("y") == t).orderBy(F.xxhash64("i"), "i").limit(most) for t in (True, False)]
    sample = F.broadcast(picked[0].union(picked[1]))  # 2 x most rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                found = [features(t)[:most_words] for t in batch.column("t").to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))], ["i", "y", "f"])

    texts = docs.select(F.col(id_column).cast("long").alias("i"), F.coalesce(F.col(text_column), F.lit("")).alias("t")).join(sample, "i")
    texts = texts.groupBy("i", "y").agg(F.min("t").alias("t")).select("i", F.col("y").cast("int").alias("y"), "t")
    table = texts.mapInArrow(run, "i long, y int, f array<long>").toArrow().sort_by([("i", "ascending"), ("y", "ascending")])
    lists = table["f"].combine_chunks()
    values, offsets = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    own = [values[a - offsets[0] : b - offsets[0]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return fit_with_cut(own, np.asarray(table["y"]).astype(float), counts.get(True, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_column: str = "text") -> DataFrame:
    """The kept columns with severity (0 to 2), p_toxic, grade (0 to 2) and toxic (boolean) for every row."""
    own = [f"_k{i}" for i in range(len(keep))]
    text = own[keep.index(text_column)] if text_column in keep else "_t"  # a text that is kept is sent once
    added = [("severity", T.DoubleType()), ("p_toxic", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                p = np.array([model.severity(t) for t in batch.column(text).to_pylist()]).reshape(-1, 2)
                toxic = p[:, 0] >= model.cut
                grade = np.where(toxic, 1 + (p[:, 1] >= 0.5), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(p.sum(1)), pa.array(np.ascontiguousarray(p[:, 0])), pa.array(grade), pa.array(toxic)], [*own, *(n for n, _ in added)])

    plain = docs.select(*(F.col(c).alias(o) for c, o in zip(keep, own, strict=True)), *[F.col(text_column).alias("_t")] * (text == "_t"))
    schema = T.StructType([*(T.StructField(o, docs.schema[c].dataType) for o, c in zip(own, keep, strict=True)), *(T.StructField(n, k) for n, k in added)])
    return plain.mapInArrow(run, schema).withColumnsRenamed(dict(zip(own, keep, strict=True)))
