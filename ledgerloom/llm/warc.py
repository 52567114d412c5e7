"""WARC archives: writing with revisits, reading back, and an externally merged capture index.

Writing: a payload of at least `least` bytes that several records share is stored once, by the record
with the largest id; the others become revisit records that name it. Every task writes one gzip
archive, a member for each record, below the shared folder, first under a name of its attempt and
then moved, and hands over the file's name; only names that Spark committed are ever read.

Reading: archives are read record by record; digests of stored payloads are checked against the
payload, and a revisit's full length is that of the HTTP header which it keeps.

Index: captures read back are written as runs, each sorted by URL key, timestamp and id. An exchange
by ranges of that key hands every merging task its slice of all runs; a loser tree merges the slices,
so task after task gives the captures of all archives in one global order. Ranges include the id, so
a URL with very many captures is divided too.

Defined results: null payload is empty; a null URL has the empty key; repeated ids give a record
each, and equal rows of the largest id all store their payload; null ids are written as empty, read as
null and count as the smallest; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import cut, shared_dir

LEAST, LEVEL, READ_BYTES = 1000, 1, 1 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _files(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query: `http://www.a.example/x?y=1` is `example,a)/x?y=1`."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d+)?([^#]*)", url or "")
    host = m[1].lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){m[2].lower() or '/'}" if host else ""


def record(kind: str, ident: str, url: str, date: str, payload: bytes, digest: str, target: str = "") -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{ident}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
    if kind == "revisit":
        head += f"WARC-Profile: {_REVISIT}\r\nWARC-Refers-To: <urn:page:{target}>\r\n"
    head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def members(stream) -> Iterator[bytes]:
    """Each gzip member of a stream, unpacked; one member at a time is held."""
    pending = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = pending or stream.read(READ_BYTES)
            pending = b""
            if not data:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(unpacker.decompress(data))
        pending = unpacker.unused_data
        yield b"".join(parts)


def parse(member: bytes) -> dict:
    head, _, block = member.partition(b"\r\n\r\n")
    block = block[:-4]
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if int(fields["Content-Length"]) != len(block) or kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    name = lambda k: fields[k][len("<urn:page:") : -1] if k in fields else None
    return {"id": name("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "date": fields["WARC-Date"], "kind": kind, "digest": digest, "bytes": length, "target": name("WARC-Refers-To"), "payload": payload if kind == "response" else None}


class LoserTree:
    """Merges sorted sequences of tuples. Each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.nodes = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.nodes[node] < 0:  # while building: waits for an opponent
                self.nodes[node] = winner
                return
            if self._beats(self.nodes[node], winner):
                self.nodes[node], winner = winner, self.nodes[node]
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and (head := self.heads[self.nodes[0]]) is not None:
            yield head
            i = self.nodes[0]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def revisits(sized: DataFrame, least: int = LEAST, salts: int = 16) -> DataFrame:
    """(id, digest, target) of the records that another record stores. sized: (id, digest, bytes).

    The largest id of a digest comes from partial aggregates; only digests that occur twice are
    joined back, and each of them is spread over `salts` parts, as one may hold a third of all rows.
    """
    large = sized.where(F.col("bytes") >= least)
    top = large.groupBy("digest").agg(F.max("id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "target")
    spread = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = large.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return salted.join(spread, ["digest", "salt"]).where(~F.col("id").eqNullSafe(F.col("target"))).select("id", "digest", "target").distinct()


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST) -> DataFrame:
    """Archives below folder; (file, records) of those that were committed. A capture's time is EPOCH plus its id in seconds."""
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    plain = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    again = cut(revisits(plain.select("id", "digest", F.octet_length("payload").alias("bytes")), least), "warc-revisits")
    again = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), "target", F.lit(True).alias("again"))
    full = plain.join(again, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").drop("again_id", "again_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, records = None, 0
        for batch in batches:
            for x in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/.{name}", compression=None)
                date = (EPOCH + timedelta(seconds=(x["id"] or 0) % (10**9))).strftime("%Y-%m-%dT%H:%M:%SZ")
                text = lambda v: "" if v is None else str(v)
                url = re.sub(r"[\r\n]", " ", x["url"] or "")
                out.write(record("revisit" if x["again"] else "response", text(x["id"]), url, date, x["payload"], x["digest"], text(x["target"])))
                records += 1
        if out is not None:
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

    return cut(full.mapInArrow(run, "file string, records long"), "warc-files")


def read(spark, files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives, one task at a time going through an archive."""
    schema = "id long, url_key string, captured timestamp, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        rows: list[tuple] = []
        held = 0
        kinds = [pa.int64(), pa.string(), pa.timestamp("us", "UTC"), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * payloads]
        names = [c.split()[0] for c in schema.split(", ")]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        number = lambda v: int(v) if v else None
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for m in members(f):
                        x = parse(m)
                        at = datetime.strptime(x["date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC)
                        rows.append((number(x["id"]), url_key(x["url"]), at, x["url"], x["kind"], x["digest"], x["bytes"], number(x["target"]), *[x["payload"]] * payloads))
                        held += len(x["payload"] or b"") * payloads
                        if len(rows) >= 5000 or held > 4_000_000:
                            yield out()
                            rows.clear()
                            held = 0
        if rows:
            yield out()

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.select("file").repartition(tasks).mapInArrow(run, schema)


KEY = ["url_key", "captured", "id"]


def runs(captures: DataFrame) -> DataFrame:
    """Captures as locally sorted runs in the shared folder, each row with the number of its run."""
    return cut(captures.withColumn("run", F.spark_partition_id()).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in KEY)), "warc-runs")


def merge(sorted_runs: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows of all runs with range_no and range_at: their global order is that of (range_no, range_at)."""
    spark = sorted_runs.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in sorted_runs.schema}
    names = [c for c in kinds if c != "run"]
    key = [names.index(c) for c in KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            columns = [batch.column(c).to_pylist() for c in names]
            for r, *row in zip(batch.column("run").to_pylist(), *columns, strict=True):
                slices.setdefault(r, []).append(((row[key[0]] or "", row[key[1]].timestamp(), -1 if row[key[2]] is None else row[key[2]]), tuple(row)))
        if schema is None:
            return
        for s in slices.values():  # a slice comes in the order of its run; a fetch may have been repeated
            if any(a[0] > b[0] for a, b in zip(s, s[1:], strict=False)):
                s.sort(key=lambda x: x[0])
        task, rows, at = TaskContext.get().partitionId(), [], 0
        kind = [schema.field(c).type for c in names]

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kind, strict=True)]
            order = [pa.array([task] * len(rows), pa.int32()), pa.array(range(at - len(rows), at), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *order], [*names, "range_no", "range_at"])

        for _, row in LoserTree([slices[r] for r in sorted(slices)]):
            rows.append(row)
            at += 1
            if len(rows) == 10_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = sorted_runs.repartitionByRange(tasks, *(F.col(c).asc_nulls_first() for c in KEY))
    return ranged.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "range_no int, range_at long"]))


def archive(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least: int = LEAST) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back and gives the merged capture index."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    files = write(pages, folder, id_column, url_column, payload_column, least)
    return merge(runs(read(spark, files, folder)))
