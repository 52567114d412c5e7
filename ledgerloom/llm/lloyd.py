"""Codes of vectors by one codebook a part, trained by delta-maintained Lloyd rounds.

Vectors become integers floor(scale * x) and are cut into equal consecutive parts; each part position has a
codebook of its own. A round assigns every part to its nearest entry and writes the rows with this and the
previous assignment to the shared folder. Only parts whose assignment changed contribute to the running sums:
plus to the new entry, minus to the old one, added up within a task first, so that a task sends one row at
most for each entry that it touches. The running sums are a table of their own, at most parts x entries rows,
whatever the number of vectors; only they reach the driver, which divides them and ships the codebooks with the next round.

Defined results: vectors that are null or hold null or a non-finite component take no part; shorter vectors,
and lengths that the parts do not divide, are padded with zeros; the first codebook takes rows in order of id,
of equal ids by their components, rows without an id last, and has fewer entries if there are fewer rows;
repeated rows are rows like any other; null labels are one label; an empty table gives no rows. Sums and
distances are exact at any size; an error, or a sum of errors, that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.topk import SCALE, _matrix
from ledgerloom.storage import Shelf

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Numbers that a task turns into distances at a time, and the share of rows above which a label is frequent.
AT_ONCE, HOT_SHARE = 1 << 20, 1000


def padded(column: pa.Array, wide: int, scale: int) -> np.ndarray:
    """Weights of a list column with `wide` components, as int64 or, if large, as Python integers."""
    own = _matrix(column, scale)
    out = np.zeros((len(own), wide), own.dtype)
    out[:, : own.shape[1]] = own
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of several, and the squared distance, exactly."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    most = max(int(abs(m).max(initial=0)) for m in (x, entries))
    bound = 4 * most * most * x.shape[1]
    kind = np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object
    a, c = x.astype(kind), entries.astype(kind)
    apart = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
    best = apart.argmin(1)
    own = apart[np.arange(len(a)), best]
    return best, own if kind is object else own.astype(np.int64)


def assigned(w: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries (rows, parts) and the sum of squared distances of each row; books are (parts, entries, components)."""
    d = books.shape[2]
    found = [nearest(w[:, p * d : (p + 1) * d], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], 1), sum(f[1].astype(object) for f in found)


class Sums:
    """Counts and sums of parts by (part, entry)."""

    def __init__(self, parts: int, entries: int, d: int):
        self.entries, self.d = entries, d
        self.n, self.s = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, d), object)

    def add(self, w: np.ndarray, part: int, entry: np.ndarray, sign: int) -> None:
        key = part * self.entries + entry
        np.add.at(self.n, key, sign)
        kind = np.int64 if w.dtype != object and int(abs(w).max(initial=0)) * max(1, len(w)) < 2**62 else object
        own = np.zeros((len(self.n), self.d), kind)
        np.add.at(own, key, sign * w.astype(kind))
        self.s += own

    def rows(self) -> list[tuple[int, int, int, list[str]]]:
        used = [k for k in range(len(self.n)) if self.n[k] or self.s[k].any()]
        return [(*divmod(k, self.entries), int(self.n[k]), [str(x) for x in self.s[k]]) for k in used]


_SUMS = "part int, entry int, n long, s array<string>"
_SUMS_ARROW = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.string()))])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SUMS_ARROW)], schema=_SUMS_ARROW)


def _added(t: pa.Table) -> pa.Table:
    """The sum of the rows of one (part, entry): one row a task, or the running sum."""
    s = [sum(map(int, xs)) for xs in zip(*t["s"].to_pylist(), strict=True)]
    return _table([(t["part"][0].as_py(), t["entry"][0].as_py(), sum(t["n"].to_pylist()), [str(x) for x in s])])


def _steps(batch: pa.RecordBatch, wide: int) -> Iterator[pa.RecordBatch]:
    step = max(1, AT_ONCE // max(1, wide))
    for low in range(0, batch.num_rows, step):
        yield batch.slice(low, step)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, parts).astype(np.int64)


def _assign(rows: DataFrame, books: np.ndarray, wide: int, scale: int) -> DataFrame:
    """Rows (id, label, v, code) with `was`, the code so far, the new one and the error."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _steps(whole, wide):
                code, error = assigned(padded(batch.column("v"), wide, scale), books)
                errors = pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())
                new = pa.array([c.tobytes() for c in code.astype("<u2")], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("id", "label", "v", "code")), new, errors], ["id", "label", "v", "was", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"id {kind['id']}, label {kind['label']}, v {kind['v']}, was binary, code binary, error long")


def _deltas(rows: DataFrame, parts: int, entries: int, wide: int, scale: int) -> DataFrame:
    """What parts whose assignment changed add to and take from the sums, one row a task and entry at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = wide // parts
        sums = Sums(parts, entries, d)
        for whole in batches:
            for batch in _steps(whole, wide):
                w, new = padded(batch.column("v"), wide, scale), _codes(batch.column("code"), parts)
                first = batch.column("was").null_count > 0
                old = None if first else _codes(batch.column("was"), parts)
                for p in range(parts):
                    moved = slice(None) if first else np.flatnonzero(old[:, p] != new[:, p])
                    own = w[moved, p * d : (p + 1) * d]
                    sums.add(own, p, new[moved, p], 1)
                    if not first:
                        sums.add(own, p, old[moved, p], -1)
        yield from _table(sums.rows()).to_batches()

    changed = rows.where(~F.col("was").eqNullSafe(F.col("code"))).select("v", "was", "code")
    return changed.mapInArrow(run, _SUMS)


def encode(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) with code as array<int>, and the final codebooks (parts, entries, components) as Python integers."""
    if not 0 < entries <= 1 << 16:
        raise ValueError("a code has two bytes")
    shelf = Shelf(rows.sparkSession)
    v = F.col(vector_column)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(id_column).alias("id"), F.col(label_column).alias("label"), v.alias("v"), F.lit(None).cast("binary").alias("code")).where(v.isNotNull() & finite)
    longest = own.agg(F.max(F.size("v"))).first()[0] or 0
    wide = -(-longest // parts) * parts
    # At most `entries` rows reach the driver.
    first = own.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    start = padded(first["v"], wide, scale).astype(object)
    books = np.stack([start[:, p * (wide // parts) : (p + 1) * (wide // parts)] for p in range(parts)])
    used = max(1, len(start))
    sums = None
    for turn in range(rounds):
        table = shelf.cut(_assign(own, books, wide, scale).drop("error"), f"assigned-{turn}")
        delta = _deltas(table, parts, used, wide, scale)
        total = (delta if sums is None else sums.union(delta)).groupBy("part", "entry").applyInArrow(_added, _SUMS)
        sums = shelf.cut(total, f"sums-{turn}")
        shelf.drop(f"assigned-{turn - 1}", f"sums-{turn - 1}")
        for r in sums.toArrow().to_pylist():  # parts x entries rows at most
            if r["n"]:
                books[r["part"], r["entry"]] = [int(x) // r["n"] for x in r["s"]]
        own = table.select("id", "label", "v", "code")
    found = _assign(own, books, wide, scale).select(F.col("id").alias(id_column), "label", _numbers(parts).alias("code"), "error")
    out = shelf.cut(found, "codes")
    shelf.paths.pop("codes")
    shelf.clear()
    return out, books


def _numbers(parts: int):
    """The entries of a code, of two bytes each, the lower first."""
    byte = lambda k: F.conv(F.hex(F.substring("code", k, 1)), 16, 10).cast("int")
    return F.array(*(byte(2 * p + 1) + 256 * byte(2 * p + 2) for p in range(parts)))


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error, the sum of the errors of equal labels; frequent labels, fewer than HOT_SHARE, go to every task."""
    whole = F.sum(F.col("error").cast("decimal(20,0)"))
    sums = codes.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), whole).alias("e"), F.count(F.lit(1)).alias("n"))
    sums = sums.select(F.col("label").alias("of"), F.expr("try_cast(e as long)").alias("label_error"), "n")
    most = max(1, codes.count() // HOT_SHARE)
    hot = F.broadcast(sums.where((F.col("n") > most) | F.col("of").isNull()).withColumn("hot", F.lit(True)).drop("n"))
    marked = codes.join(hot, F.col("label").eqNullSafe(F.col("of")), "left")
    crowd = marked.where("hot").select(*codes.columns, "label_error")
    rest = marked.where("hot is null").select(*codes.columns).join(sums.where(F.col("n") <= most), F.col("label") == F.col("of"))
    return crowd.union(rest.select(*codes.columns, "label_error"))


def sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
