"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over 32 bytes cuts each text where its content says so, so a passage that many
documents share is cut alike in all of them. A Python worker encodes each such chunk once, for as
long as the bounded cache holds it (it outlives the task), and puts documents together from chunk
encodings. A cut may fall inside a word, so each join is repaired: the bytes around it are encoded
again together with complete words of either side until the new tokens agree exactly with what the
two chunks hold for those words.

Defined results: null text is the empty text (no ids, empty decoded text); repeated rows and ties
give one row each; a null id stays null; other columns of the input are ignored unless named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import wordbpe

SMALLEST, LARGEST, CUT_BITS, WINDOW = 64, 8192, 9, 32
CHUNKS_KEPT, BATCH_BYTES = 8192, 2_000_000

_GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**32, 256, dtype=np.uint32)
_SPACES = b" \t\n\r\x0b\x0c"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(_SPACES)] = True


def cuts(text: bytes, smallest: int = SMALLEST, largest: int = LARGEST, bits: int = CUT_BITS) -> list[int]:
    """Offsets at which text is cut, each between two characters; the end is not among them."""
    b = np.frombuffer(text, np.uint8)
    if len(b) <= smallest:
        return []
    h = _GEAR[b]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    found, last = [], 0
    for at in [*(np.flatnonzero(h[:-1] >> np.uint32(32 - bits) == 0) + 1).tolist(), len(b)]:
        while at - last > largest:
            last += largest
            while b[last] & 0xC0 == 0x80:
                last -= 1
            found.append(last)
        if at - last >= smallest and at < len(b) and b[at] & 0xC0 != 0x80:
            found.append(at)
            last = at
    return found


class ChunkEncoder:
    """Ids of a text as native unsigned 32-bit bytes, and its decoded text."""

    def __init__(self, vocabulary: str):
        self.bpe = wordbpe.load(vocabulary)
        self.chunks = wordbpe.Bounded(self._chunk, CHUNKS_KEPT)

    def _plain(self, text: bytes) -> tuple[bytes, str]:
        ids = self.bpe.encode(text)
        return ids, self.bpe.decode(ids)

    def _chunk(self, chunk: bytes):
        """(bytes before the first space, complete words, bytes after the last, ids, decoded); words is None without a space."""
        spaces = np.flatnonzero(_IS_SPACE[np.frombuffer(chunk, np.uint8)])
        if not len(spaces):
            return chunk, None, b"", b"", ""
        first, last = int(spaces[0]), int(spaces[-1])
        words = chunk[first : last + 1]
        return (chunk[:first], words, chunk[last + 1 :], *self._plain(words))

    def repaired(self, before: bytes, seam: bytes, after: bytes) -> tuple[bytes, str]:
        """Encoding of the bytes around a join; before, after: the complete words of either chunk."""
        reach = 1
        while True:
            head = b" ".join(before.rsplit(None, reach)[-reach:])
            tail = b" ".join(after.split(None, reach)[:reach])
            left, right = self.bpe.encode(head), self.bpe.encode(tail)
            ids = self.bpe.encode(b" ".join([head, seam, tail]))
            if ids.startswith(left) and ids.endswith(right) and len(ids) >= len(left) + len(right):
                ids = ids[len(left) : len(ids) - len(right)]
                return ids, self.bpe.decode(ids)
            if len(head) >= len(before) and len(tail) >= len(after):
                raise ValueError("the encodings of two chunks do not agree with that of their join")
            reach *= 2

    def encode(self, text: bytes) -> tuple[bytes, str]:
        ids, decoded, pending, before = [], [], b"", b""
        start = 0
        for end in [*cuts(text), len(text)]:
            left, words, right, own_ids, own_decoded = self.chunks[text[start:end]]
            start = end
            if words is None:
                pending += left
                continue
            if seam := pending + left:
                x = self.repaired(before, seam, words)
                ids.append(x[0])
                decoded.append(x[1])
            ids.append(own_ids)
            decoded.append(own_decoded)
            pending, before = right, words
        if pending:
            x = self.repaired(before, pending, b"")
            ids.append(x[0])
            decoded.append(x[1])
        return b"".join(ids), " ".join([x for x in decoded if x])


_encoders: dict[str, ChunkEncoder] = {}


def encoder(vocabulary: str) -> ChunkEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = ChunkEncoder(vocabulary)
    return _encoders[vocabulary]


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in a column each, one row at least."""
    lengths = batch.column(column)
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(lengths), 0)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        floor = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, floor + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def encode(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text: no special tokens added, none skipped in decoding."""
    vocabulary = vocabulary or wordbpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for whole in batches:
            for batch in slices(whole, "b"):
                found = [own.encode(x or b"") for x in batch.column("b").to_pylist()]
                ends = np.cumsum([0, *(len(x[0]) // 4 for x in found)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join([x[0] for x in found]), np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("i"), ids, pa.array([x[1] for x in found], pa.string())], ["i", "ids", "decoded"])

    kind = docs.schema[id_column].dataType.simpleString()
    plain = docs.select(F.col(id_column).alias("i"), F.col(text_column).cast("binary").alias("b"))
    return plain.mapInArrow(run, f"i {kind}, ids array<int>, decoded string").withColumnRenamed("i", id_column)
