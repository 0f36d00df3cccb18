"""Exact removal of repeated lines, with Bloom filters in front of the shuffle."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.workers import tidy
from vitrine.sources.shared import fresh, materialize

#: Bits of a slice of the filters: what one merging task holds at a time, twice.
SLICE_BITS = 1 << 19
#: Most bits of a whole filter (64 MB; a task fills two), which executors get by broadcast. Beyond it more lines are suspected, and shuffle; results stay the same.
FILTER_BITS = 1 << 29
#: Repeated lines whose keys take at most so many bytes are broadcast; beyond, they meet the documents in a join.
BROADCAST_BYTES = 32 << 20


def line_key(line: bytes) -> bytes:
    """White space (bytes 0x20 and 0x09 to 0x0D) stripped at both ends, A-Z lower-cased."""
    return line.strip().lower()


def _bits(keys: list[bytes], size: int) -> np.ndarray:
    """Two bit positions of each key in a filter of `size` bits (a power of two): shape (keys, 2)."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    mask = np.uint64(size - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask], 1).astype(np.int64)


def _held(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether `bits` (packed, highest first) has all positions of each row of `at`."""
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)


def _put(bits: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))


def filter_size(lines: int, most: int = FILTER_BITS) -> int:
    """A power of two with 8 bits or more a line, between one slice and `most`."""
    size = SLICE_BITS
    while size < min(8 * lines, most):
        size *= 2
    return size


def twice_seen(docs: DataFrame, text_col: str, size: int) -> bytes:
    """A Bloom filter of `size` bits that holds the key of every line found in two documents or more.

    Each task keeps two filters: what it saw once goes into the first, what is there already into
    the second. Filters of tasks merge slice by slice (once: or; twice: or, with what both saw once), so the
    second filter misses no repeated line; it may hold others. Slices travel compressed, empty ones don't.
    """

    @tidy
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = set(map(line_key, (text or "").encode().split(b"\n"))) - {b""}
                if not keys:
                    continue
                at = _bits(list(keys), size)
                _put(twice, at[_held(once, at)])
                _put(once, at)
        for k in range(size // SLICE_BITS):
            part = slice(k * SLICE_BITS // 8, (k + 1) * SLICE_BITS // 8)
            if once[part].any():
                both = [zlib.compress(x[part].tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x], pa.binary()) for x in both)], names=["slice", "once", "twice"])

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in (once, twice))], names=["slice", "once", "twice"])

        for batch in batches:
            for row in batch.to_pylist():
                new_once, new_twice = (np.frombuffer(zlib.decompress(row[x]), np.uint8) for x in ("once", "twice"))
                if row["slice"] == at:
                    twice = twice | new_twice | (once & new_once)
                    once = once | new_once
                    continue
                if at is not None:
                    yield out()
                at, once, twice = row["slice"], new_once, new_twice
        if at is not None:
            yield out()

    schema = "slice int, once binary, twice binary"
    built = docs.select(text_col).mapInArrow(build, schema)
    merged = built.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, schema)
    whole = bytearray(size // 8)
    for row in merged.select("slice", "twice").toLocalIterator():
        whole[row["slice"] * SLICE_BITS // 8 : (row["slice"] + 1) * SLICE_BITS // 8] = zlib.decompress(row["twice"])
    return bytes(whole)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_chars: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(key binary, n_docs, first_doc, first_line) of the line keys in at least `min_docs` rows of `docs`.

    Only lines that the twice-seen filter suspects leave their task; they are counted by the key itself, with partial
    counts before the shuffle, so a false suspicion changes nothing.
    """
    spark = docs.sparkSession
    lines = docs.select(F.sum(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1).alias("n")).first()["n"] or 0
    size = filter_size(lines, filter_bits)
    suspects = spark.sparkContext.broadcast(twice_seen(docs, text_col, size))
    doc_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc", doc_type), T.StructField("line", T.LongType())])

    @tidy
    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(suspects.value, np.uint8)
        for batch in batches:
            found, docs_at, lines_at = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                first: dict[bytes, int] = {}
                for n, line in enumerate((text or "").encode().split(b"\n")):
                    first.setdefault(line_key(line), n)
                first.pop(b"", None)
                if not first:
                    continue
                keys = list(first)
                at = _bits(keys, size)
                for j in np.flatnonzero(_held(held, at)):
                    if min_chars <= 1 or len(keys[j].decode()) >= min_chars:
                        found.append(keys[j])
                        docs_at.append(k)
                        lines_at.append(first[keys[j]])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(0).take(pa.array(docs_at, pa.int32())), pa.array(lines_at, pa.int64())], names=["key", "doc", "line"])

    rows = docs.select(id_col, text_col).mapInArrow(suspected, schema)
    first = F.min(F.struct("doc", "line"))
    counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), first.alias("first")).where(F.col("n_docs") >= min_docs)
    return counted.select("key", "n_docs", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES, filter_bits: int = FILTER_BITS, n_lines_col: str = "n_lines", n_dropped_col: str = "n_dropped") -> DataFrame:
    """Drop the lines whose key is found in at least `min_docs` rows of `docs`.

    keep: "none" drops them everywhere, "first" leaves the one in the row of the smallest id, at its first place there.
    Returns all columns of `docs` with the new text, n_lines (before) and n_dropped, by the names given (columns of these names are replaced). Texts are split at \\n; a null
    text counts as one empty line and comes back empty; lines shorter than `min_chars` code points (by key) always stay; of rows with the same id
    each counts as a document, and each keeps the first occurrence if theirs is the smallest id.
    """
    spark = docs.sparkSession
    repeated = materialize(repeated_lines(docs, id_col, text_col, min_docs, max(min_chars, 1), filter_bits), "lines")
    total = repeated.agg(F.sum(F.octet_length("key") + 24).alias("n")).first()["n"] or 0
    columns = [c for c in docs.columns if c not in (n_lines_col, n_dropped_col)]
    schema = T.StructType([*(docs.schema[c] if c != text_col else T.StructField(text_col, T.StringType()) for c in columns), T.StructField(n_lines_col, T.LongType()), T.StructField(n_dropped_col, T.LongType())])
    text_at, id_at = columns.index(text_col), columns.index(id_col)

    def cleaned(batch: pa.RecordBatch, drops) -> pa.RecordBatch:
        """drops(row, keys): the line numbers to drop."""
        texts, n_lines, n_dropped = [], [], []
        for k, text in enumerate(batch.column(text_at).to_pylist()):
            lines = (text or "").encode().split(b"\n")
            gone = drops(k, [line_key(x) for x in lines])
            texts.append(b"\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else text or "")
            n_lines.append(len(lines))
            n_dropped.append(len(gone))
        new = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else batch.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays([*new, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[f.name for f in schema])

    if total <= broadcast_bytes:
        known = spark.sparkContext.broadcast({bytes(r["key"]): (r["first_doc"], r["first_line"]) for r in repeated.toLocalIterator()})

        @tidy
        def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = known.value
            for batch in batches:
                ids = batch.column(id_at).to_pylist()
                yield cleaned(batch, lambda k, keys: {n for n, x in enumerate(keys) if x in table and not (keep == "first" and table[x] == (ids[k], n))})

        return docs.select(columns).mapInArrow(by_broadcast, schema)

    # more repeated lines than a broadcast takes: each row's own come to it by a row number that the written lines carry
    row_at, gone_col = fresh(columns, "row_at"), fresh(columns, "gone_lines")
    numbered = materialize(docs.select(columns).withColumn(row_at, F.monotonically_increasing_id()), "rows")

    @tidy
    def own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, docs_at, lines_at = [], [], [], []
            row_ids = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(2).to_pylist()):
                for n, line in enumerate((text or "").encode().split(b"\n")):
                    if key := line_key(line):
                        keys.append(key)
                        rows.append(row_ids[k])
                        docs_at.append(k)
                        lines_at.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(rows, pa.int64()), batch.column(1).take(pa.array(docs_at, pa.int32())), pa.array(lines_at, pa.int64())], names=["key", "row_at", "doc", "line"])

    own = numbered.select(row_at, id_col, text_col).mapInArrow(own_lines, T.StructType([T.StructField("key", T.BinaryType()), T.StructField("row_at", T.LongType()), T.StructField("doc", docs.schema[id_col].dataType), T.StructField("line", T.LongType())]))
    gone = own.join(repeated, "key")
    if keep == "first":
        gone = gone.where(~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("line") == F.col("first_line"))))
    lists = gone.groupBy(F.col("row_at").alias(row_at)).agg(F.collect_list("line").alias(gone_col))

    @tidy
    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone_lines = batch.column(len(columns)).to_pylist()
            yield cleaned(batch, lambda k, keys: set(gone_lines[k] or ()))

    return numbered.join(lists, row_at, "left").select(*columns, gone_col).mapInArrow(by_join, schema)
