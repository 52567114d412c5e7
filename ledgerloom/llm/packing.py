"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Documents are encoded and cut into pieces of at most `piece` tokens. Blocks of consecutive pieces,
each filled to just under a whole number of windows, are dealt into that many windows: every piece
starts as a partition of its own, and the two partitions with the largest imbalance are merged
again and again, the fullest windows of one with the emptiest of the other. Should a window come
out over capacity the block gets one more. Stretches of a document that fill a window alone are
windows as they are. Blocks never leave their task, so nothing is shuffled. A block of `most` pieces
gives up as many of them as fill whole windows, so that very short documents take no more memory.

Defined results: null text is empty, and such a document is its end token alone; a null id stays
null; repeated rows are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import wordbpe
from ledgerloom.llm.bpe import slices

CAPACITY, PIECE, WINDOWS, SLACK, MOST = 4096, 512, 128, 8, 32_768


def differencing(sizes: list[int], m: int) -> list[int]:
    """The window, 0 to m - 1, of each size."""
    left, right, item = [-1], [-1], [-1]  # node 0: an empty window; else an item or the union of two nodes
    heap = []
    for i, size in enumerate(sizes):
        left.append(-1)
        right.append(-1)
        item.append(i)
        totals, nodes = np.zeros(m, np.int64), np.zeros(m, np.int64)
        totals[0], nodes[0] = size, len(item) - 1
        heap.append((-size, i, totals, nodes))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        b, y = b[::-1], y[::-1]
        totals, nodes = a + b, np.where(x == 0, y, x)
        for k in np.flatnonzero((x > 0) & (y > 0)).tolist():
            left.append(int(x[k]))
            right.append(int(y[k]))
            item.append(-1)
            nodes[k] = len(item) - 1
        order = np.argsort(-totals, kind="stable")
        totals, nodes = totals[order], nodes[order]
        heapq.heappush(heap, (int(totals[-1] - totals[0]), turn, totals, nodes))
        turn += 1
    window = [0] * len(sizes)
    for w, root in enumerate(heap[0][3].tolist() if heap else []):
        stack = [root] if root else []
        while stack:
            node = stack.pop()
            if item[node] >= 0:
                window[item[node]] = w
            else:
                stack += [left[node], right[node]]
    return window


def balanced(sizes: list[int], capacity: int) -> list[int]:
    """Windows of the sizes, none over capacity; their number rises until that holds."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, m)
        if not sizes or np.bincount(window, sizes, m).max() <= capacity:
            return window
        m += 1


class Packer:
    """Takes documents one by one, gives rows (index of document, start, length, crc, tokens, window, offset)."""

    def __init__(self, capacity: int, piece: int, windows: int, slack: int, most: int = MOST):
        self.capacity, self.piece, self.windows, self.most = capacity, min(piece, capacity), windows, most
        self.slacked = max(1, capacity - slack)
        self.full = windows * self.slacked
        self.pieces, self.sizes, self.held, self.next = [], [], 0, 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, at = len(ids) // 4, 0
        crc = lambda a, b: zlib.crc32(ids[4 * a : 4 * b])
        while n - at >= self.capacity:
            yield doc, at, self.capacity, crc(at, at + self.capacity), n, self.next, 0
            self.next += 1
            at += self.capacity
        while at < n:
            size = min(n - at, self.piece, self.full - self.held)
            self.pieces.append((doc, at, size, crc(at, at + size), n))
            self.sizes.append(size)
            self.held += size
            at += size
            if self.held == self.full:
                yield from self.flush()
            elif len(self.pieces) >= self.most:
                yield from self.flush(self.held - self.held % self.slacked or self.held)

    def flush(self, tokens: int | None = None) -> Iterator[tuple]:
        """Packs the first pieces, of at most so many tokens, or all."""
        later: list[tuple] = []
        while tokens is not None and self.held > tokens and len(self.pieces) > 1:
            later.append((self.pieces.pop(), self.sizes.pop()))
            self.held -= later[-1][1]
        window = balanced(self.sizes, self.capacity)
        offset: dict[int, int] = {}
        for (doc, at, size, crc, n), w in zip(self.pieces, window, strict=True):
            yield doc, at, size, crc, n, self.next + w, offset.get(w, 0)
            offset[w] = offset.get(w, 0) + size
        self.next += max(window, default=-1) + 1
        self.pieces, self.sizes = [p for p, _ in reversed(later)], [n for _, n in reversed(later)]
        self.held = sum(self.sizes)


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 2,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    windows: int = WINDOWS,
    slack: int = SLACK,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    sequence_id holds the task's partition in its upper bits, so it is unique without any exchange.
    """
    vocabulary = vocabulary or wordbpe.default_vocabulary()
    names = ["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = wordbpe.load(vocabulary).encode, np.array([end_id], np.uint32).tobytes()
        packer, base = Packer(capacity, piece, windows, slack), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            columns[5] = [base + x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:])], names)

        kind = pa.int64()
        for whole in batches:
            kind = whole.schema.field("i").type
            for batch in slices(whole, "b"):
                for doc, text in zip(batch.column("i").to_pylist(), batch.column("b").to_pylist(), strict=True):
                    rows += packer.add(doc, encode(text or b"") + end)
                if len(rows) >= 20_000:
                    yield out()
        rows += packer.flush()
        if rows:
            yield out()

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("i"), F.col(text_column).cast("binary").alias("b"))
    schema = f"i {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return plain.mapInArrow(run, schema).withColumnRenamed("i", id_column)
