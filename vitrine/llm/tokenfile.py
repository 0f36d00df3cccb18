"""Token ids in fixed-width bit-packed blocks: a parquet table of blocks in ascending document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.packing import ENCODE_CHARS
from vitrine.llm.tokens import CACHE_WORDS, encoder, runs_of, text_lengths
from vitrine.llm.workers import tidy

#: Ids of a block; a longer document is cut into blocks of its own.
BLOCK_IDS = 65_536

#: One row a block. part: the writing task, in document order; block: place in the part; first_id: ids of the part before the block;
#: doc_ids, doc_starts: the documents that begin in the block, and where; cut: which slice this is of a document that is longer than a block.
BLOCKS = "part int, block int, first_id long, n_ids int, width int, payload binary, doc_ids array<long>, doc_starts array<int>, cut int"


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """`ids` at `width` bits each (1 to 32), lowest bit first; the last byte is filled with zeros.

    Eight ids take `width` bytes, so each of the eight lanes is shifted into place for all groups at once.
    """
    if width % 8 == 0:
        return np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), width), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = lanes[:, lane] << np.uint64(shift)
        for k in range(-(-(shift + width) // 8)):
            out[:, byte + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * width // 8)]


def unpack_bits(payload: bytes, width: int, n: int) -> np.ndarray:
    """The `n` ids that pack_bits() wrote."""
    if width % 8 == 0:
        whole = np.zeros((n, 4), np.uint8)
        whole[:, : width // 8] = np.frombuffer(payload, np.uint8).reshape(n, width // 8)
        return whole.view("<u4").reshape(-1)
    groups = -(-n // 8)
    raw = np.zeros(groups * width, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(groups, width)
    ids = np.empty((groups, 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for lane in range(8):
        byte, shift = divmod(lane * width, 8)
        value = np.zeros(groups, np.uint64)
        for k in range(-(-(shift + width) // 8)):
            value |= raw[:, byte + k].astype(np.uint64) << np.uint64(8 * k)
        ids[:, lane] = (value >> np.uint64(shift)) & mask
    return ids.reshape(-1)[:n]


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> None:
    """Encode `docs` and write their ids, each document's followed by `end_id`, in ascending order of id.

    The width is the number of bits of the largest id of the vocabulary or `end_id`. A null or empty text
    has the end id alone; documents of a null id come first; those of the same id are ordered by a hash of the
    text; an empty table gives a table without blocks. Tasks hold one block of ids, or one document, and up to twice
    `cache_words` words with their ids.
    """

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, cache_words)
        width = max(encode.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
        part, rows, done = TaskContext.get().partitionId(), 0, 0
        doc_ids, doc_starts, held, held_ids = [], [], [], 0

        def block(ids: bytes, starts: list[int], names: list, cut: int | None) -> pa.RecordBatch:
            nonlocal rows, done
            n = len(ids) // 4
            row = {"part": part, "block": rows, "first_id": done, "n_ids": n, "width": width, "payload": pack_bits(np.frombuffer(ids, "<u4"), width), "doc_ids": names, "doc_starts": starts, "cut": cut}
            rows, done = rows + 1, done + n
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for run in runs_of(text_lengths(batch.column(1)), ENCODE_CHARS):
                for name, ids in zip(names[run], encode(batch.column(1).slice(run.start, run.stop - run.start).to_pylist(), end_id), strict=True):
                    n = len(ids) // 4
                    if held and held_ids + n > block_ids:
                        yield block(b"".join(held), doc_starts, doc_ids, None)
                        doc_ids, doc_starts, held, held_ids = [], [], [], 0
                    if n > block_ids:
                        for k, at in enumerate(range(0, n, block_ids)):
                            yield block(ids[4 * at : 4 * (at + block_ids)], [0] * (not k), [name], k)
                        continue
                    doc_ids.append(name)
                    doc_starts.append(held_ids)
                    held.append(ids)
                    held_ids += n
        if held:
            yield block(b"".join(held), doc_starts, doc_ids, None)

    spark_schema = T.StructType.fromDDL(BLOCKS)
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int32()), ("width", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int32())), ("cut", pa.int32())])
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(blocks, spark_schema).write.option("compression", "zstd").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The block table at `path`, with start: the ids of all blocks before each in the whole file."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("part_start"))
    # one row for each task of the writer
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("part_start") + F.col("first_id")).drop("part_start")


def read_documents(spark: SparkSession, path: str, emit: str = "ids") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and, by `emit`, ids or ids_crc32 of each document of the file.

    Documents of one block are unpacked where the block is read. The slices of longer ones meet by document
    and are taken in order, one at a time for ids_crc32.
    """
    blocks = read_blocks(spark, path)
    whole = blocks.where(F.col("cut").isNull()).select("start", "n_ids", "width", "payload", "doc_ids", "doc_starts")
    sliced = blocks.where(F.col("cut").isNotNull()).select(F.col("doc_ids")[0].alias("doc_id"), "start", "n_ids", "width", "payload", "cut", "part", (F.col("block") - F.col("cut")).alias("opens"))
    last = "ids array<int>" if emit == "ids" else "ids_crc32 long"
    schema = f"doc_id long, start long, n_tokens long, {last}"

    @tidy
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["payload"], row["width"], row["n_ids"])
                starts = np.array([*row["doc_starts"], len(ids)])
                if emit == "ids":
                    values = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype("i4")))
                else:
                    raw = ids.astype("<u4").tobytes()
                    values = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, starts[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + starts[:-1]), pa.array(np.diff(starts)), values], names=["doc_id", "start", "n_tokens", "ids" if emit == "ids" else "ids_crc32"])

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_id, start, n, value) -> pa.RecordBatch:
            value = pa.array([np.concatenate(value).astype("i4")], pa.list_(pa.int32())) if emit == "ids" else pa.array([value], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), value], names=["doc_id", "start", "n_tokens", "ids" if emit == "ids" else "ids_crc32"])

        at = None
        for batch in batches:
            for x in batch.to_pylist():
                ids = unpack_bits(x["payload"], x["width"], x["n_ids"])
                if x["cut"] == 0:
                    if at:
                        yield row(*at)
                    at = [x["doc_id"], x["start"], 0, [] if emit == "ids" else 0]
                at[2] += len(ids)
                at[3] = [*at[3], ids] if emit == "ids" else zlib.crc32(ids.astype("<u4").tobytes(), at[3])
        if at:
            yield row(*at)

    meet = sliced.repartition("part", "opens").sortWithinPartitions("part", "opens", "cut").drop("part", "opens")
    return whole.mapInArrow(unpack, schema).unionByName(meet.mapInArrow(joined, schema))


def read_ids(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """Random access: (block start, ids) slices that make up ids `begin` to `end` of the file; other blocks are skipped."""
    blocks = read_blocks(spark, path).where((F.col("start") < end) & (F.col("start") + F.col("n_ids") > begin))

    @tidy
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                a, b = max(begin - x["start"], 0), min(end - x["start"], x["n_ids"])
                ids = unpack_bits(x["payload"], x["width"], x["n_ids"])[a:b]
                yield pa.RecordBatch.from_arrays([pa.array([x["start"] + a], pa.int64()), pa.array([ids.astype("i4")], pa.list_(pa.int32()))], names=["start", "ids"])

    return blocks.select("start", "n_ids", "width", "payload").mapInArrow(slices, "start long, ids array<int>")
