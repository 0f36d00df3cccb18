"""WARC archives as chunked record tables, written and read by Spark's own text files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.workers import tidy
from vitrine.sources.shared import materialize

#: Most payload bytes of a record; a larger payload goes on in continuation records, one row each.
CHUNK_BYTES = 32 << 10
#: Bytes of parsed chunks that the reader passes on at a time.
BATCH_BYTES = 4 << 20
#: Payloads from this size on are written once, and revisited.
REVISIT_BYTES = 100

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"  # ends a header, and a record
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CHUNKS = "row string, page_id long, record_type string, refers_to long, segment int, segments boolean, payload_bytes long, payload_digest string, running_digest string, payload binary"
_SCHEMA = pa.schema([("row", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("segment", pa.int32()), ("segments", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("running_digest", pa.string()), ("payload", pa.binary())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def first_cut(payload: bytes, most: int) -> int:
    """Where the first chunk of `payload` ends: after `most` bytes or fewer, between characters, and so that no chunk holds what separates records.

    The reader splits at the end of a record and the version line after it, so a payload with these bytes is cut within them.
    """
    n = len(payload)
    end = min(most, n)
    if payload.startswith(VERSION):
        end = 2
    elif (inside := payload.find(END + VERSION, 0, end)) >= 0:
        end = inside + len(END) + 2
    while 0 < end < n and payload[end] & 0xC0 == 0x80:
        end -= 1
    return end


def _header(fields: dict[str, object]) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + lines.encode() + b"\r\n"


class _Writer:
    """One record set as its payload's slices come: at most two chunks and a slice are held."""

    def __init__(self, own: dict[str, object], most: int):
        self.own, self.most = own, most
        self.held, self.waiting, self.k = b"", None, 0
        self.running = hashlib.sha256()

    def feed(self, slice_: bytes, last: bool) -> Iterator[bytes]:
        """The records that are complete with the next slice of the payload; the last slice ends the set."""
        self.held += slice_
        while last or len(self.held) >= self.most + len(END + VERSION):
            end = first_cut(self.held, self.most)
            chunk, self.held = self.held[:end], self.held[end:]
            done = last and not self.held
            if self.waiting is not None:
                yield self._record(self.waiting, False, True)
                self.waiting = None
            if not done and not self.k:
                self.waiting = chunk  # whether it is the only one shows with the next
            else:
                yield self._record(chunk, done, bool(self.k))
            if done:
                return

    def _record(self, chunk: bytes, done: bool, segments: bool) -> bytes:
        self.k += 1
        own, block = self.own, chunk if self.k > 1 else HTTP + chunk
        fields = {"WARC-Type": "continuation" if self.k > 1 else "response", **own, "Content-Type": "application/http; msgtype=response"}
        self.running.update(chunk)
        if segments:
            fields |= {"WARC-Segment-Number": self.k, "WARC-Running-Digest": f"sha256:{self.running.copy().hexdigest()}"}
            if self.k > 1:
                fields |= {"WARC-Record-ID": f"{own['WARC-Record-ID'][:-1]}:{self.k}>", "WARC-Segment-Origin-ID": own["WARC-Record-ID"]}
            if done:
                fields["WARC-Segment-Total-Length"] = len(HTTP) + own["WARC-Payload-Length"]
        return _header(fields | {"Content-Length": len(block)}) + block


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str = "url", date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write a record for every row of `pages`: a response with the payload, or a revisit of an equal one.

    Ids are whole numbers, or text that is one. Of the rows with equal payloads (by SHA-256) of `revisit_bytes` or more, those of the smallest id are responses
    and the others revisits; smaller payloads, and rows without an id, are always responses. A null payload is empty; a null URI is left out; line breaks in one are
    percent-encoded. Spark cuts payloads into slices, a row each, and a task turns slices into chunks as they come: those after the first are continuation records, which carry the digest of the
    payload so far. No task holds a payload over `chunk_bytes` whole outside Spark's own row of it. Only ids and digests are compared across rows; payloads move just when there are too many revisits to broadcast.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).where((F.col("n") >= revisit_bytes) & F.col("page_id").isNotNull())
    firsts = named.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    revisits = materialize(named.join(firsts, "digest").where("page_id > first").select("page_id", "digest", "first").distinct(), "revisits")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).alias("uri"), payload.cast("binary").alias("payload"), F.sha2(payload, 256).alias("digest"))

    @tidy
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, writer = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "uri", "digest", "first", "n", "slice", "slices", "bytes")]
            for x in range(len(batch)):
                page, uri, digest, first, n, at, slices, bytes_ = (c[x].as_py() for c in columns)
                if at == 0:  # the slices of a row follow each other
                    row += 1
                    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else None
                    own = {"WARC-Record-ID": f"<urn:page:{page}>", "WARC-Row": f"{part}.{row}", "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Length": n}
                    writer = _Writer(own, chunk_bytes)
                if first is not None:
                    fields = {"WARC-Type": "revisit", **own, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}>", "Content-Length": 0}
                    yield pa.RecordBatch.from_arrays([pa.array([_header(fields)], pa.binary())], names=["value"])
                    continue
                for record in writer.feed(bytes_, at == slices - 1):
                    yield pa.RecordBatch.from_arrays([pa.array([record], pa.binary())], names=["value"])

    told = rows.join(revisits, ["page_id", "digest"], "left").withColumn("n", F.octet_length("payload"))
    told = told.withColumn("slices", F.when(F.col("first").isNotNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / chunk_bytes).cast("int"))))
    told = told.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    slice_ = F.when(F.col("first").isNull(), F.substring("payload", F.col("slice") * chunk_bytes + 1, F.lit(chunk_bytes)))
    sliced = told.select("page_id", "uri", "digest", "first", "n", "slice", "slices", slice_.alias("bytes"))
    sliced.mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", END.decode()).text(path)


def _parse(value: bytes) -> dict[str, object]:
    """A record without its version line, or with it, as a row of CHUNKS."""
    head, _, block = value.removeprefix(VERSION).partition(END)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
    block = block[: int(fields["Content-Length"])]  # the last record of a file has its end left
    assert len(block) == int(fields["Content-Length"]), "the archive was cut"
    kind, k = fields["WARC-Type"], int(fields.get("WARC-Segment-Number", 1))
    page = re.match(r"<urn:page:([^:>]+)", fields["WARC-Record-ID"])[1]
    return {
        "row": fields["WARC-Row"],
        "page_id": None if page == "None" else int(page),
        "record_type": "response" if kind == "continuation" else kind,
        "refers_to": int(fields["WARC-Refers-To"][10:-1]) if kind == "revisit" else None,
        "segment": k,
        "segments": "WARC-Segment-Number" in fields,
        "payload_bytes": int(fields["WARC-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
        "running_digest": fields.get("WARC-Running-Digest", "").removeprefix("sha256:") or None,
        "payload": block.partition(END)[2] if kind == "response" else block,
    }


def _values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", (END + VERSION).decode()).text(path)


@tidy
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for value in batch.column(0):
            rows.append(_parse(value.as_py()))
            held += len(rows[-1]["payload"])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives at `path` as a table with a row for each record, oversized payloads in several (columns of CHUNKS).

    row names the written row, segment counts its chunks from 1. The reader holds some chunks at a time, and files are split among tasks.
    """
    return _values(spark, path).select(F.col("value").cast("binary")).mapInArrow(_chunks, CHUNKS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record set of the archives at `path`.

    Size and digest of a response are taken from the bytes that were read, and an error tells if they aren't those of the header; a revisit has those of
    the payload it refers to. Payloads of several chunks meet by row and pass in order, one chunk at a time; others, and revisits, stay where they are.
    """
    marked = F.col("value").contains("\r\nWARC-Segment-Number: ")

    def told(x: dict[str, object], n: int, digest: str) -> dict[str, object]:
        if (n, digest) != (x["payload_bytes"], x["payload_digest"]):
            raise ValueError(f"page {x['page_id']}: its payload isn't what its header says")
        return {k: x[k] for k in _RECORDS.names}

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Record sets from batches of chunks, which follow each other in order; a revisit, or a payload of one chunk, is a set of its own."""
        first, n, running = None, 0, None
        for batch in batches:
            done = []
            for k in range(len(batch)):
                x = {f: batch.column(f)[k].as_py() for f in _SCHEMA.names}
                if first is None or x["row"] != first["row"] or x["segment"] == 1:
                    if first:
                        done.append(told(first, n, running.hexdigest()))
                    first, n, running = x, 0, hashlib.sha256()
                if x["record_type"] == "revisit":
                    done.append(told(x, x["payload_bytes"], x["payload_digest"]))
                    first = None
                    continue
                n += len(x["payload"])
                running.update(x["payload"])
                if x["segments"] and running.copy().hexdigest() != x["running_digest"]:
                    raise ValueError(f"page {x['page_id']}: chunk {x['segment']} isn't what was written")
            yield pa.RecordBatch.from_pylist(done, _RECORDS)
        if first:
            yield pa.RecordBatch.from_pylist([told(first, n, running.hexdigest())], _RECORDS)

    @tidy
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(_chunks(batches))

    values = _values(spark, path)
    small = values.where(~marked).select(F.col("value").cast("binary")).mapInArrow(alone, RECORDS)
    large = values.where(marked).select(F.col("value").cast("binary")).mapInArrow(_chunks, CHUNKS)
    return small.unionByName(large.repartition("row").sortWithinPartitions("row", "segment").mapInArrow(joined, RECORDS))
