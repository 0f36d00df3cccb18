"""Best-fit packing of tokenised documents into fixed-length sequences, planned on the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.tokens import CACHE_WORDS, encoder, runs_of, text_lengths
from vitrine.llm.workers import tidy
from vitrine.sources.shared import materialize

#: Names of the columns that number a table's pieces: the task that wrote one, and its place among that task's pieces of the same length.
PART, NTH = "_part", "_nth"
#: Characters of text that a task encodes at a time; a longer text is encoded alone.
ENCODE_CHARS = 1_000_000


def cut(ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences at its end, and what is left before them."""
    first = ids % capacity
    starts = [0] * bool(first) + list(range(first, ids, capacity))
    return [(s, first if first and not s else capacity) for s in starts]


class Places:
    """Counts a task's pieces by length as they pass."""

    def __init__(self) -> None:
        self.part = TaskContext.get().partitionId()
        self.seen: dict[int, int] = {}

    def __call__(self, lengths: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """(task, place among its pieces of the same length) of each of the next pieces."""
        order = np.argsort(lengths, kind="stable")
        of, begin, n = np.unique(lengths[order], return_index=True, return_counts=True)
        nth = np.empty(len(lengths), np.int64)
        nth[order] = np.arange(len(lengths)) - np.repeat(begin, n) + np.repeat(np.array([self.seen.get(x, 0) for x in of.tolist()], np.int64), n)
        for x, more in zip(of.tolist(), n.tolist(), strict=True):
            self.seen[x] = self.seen.get(x, 0) + more
        return pa.array(np.full(len(lengths), self.part, np.int32)), pa.array(nth)


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, emit: str = "ids", id_col: str = "doc_id", text_col: str = "text", placed: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Each document's ids with `end_id`, cut into pieces of at most `capacity`.

    Returns doc_id, piece, start, length and, by `emit`, ids (array<int>) or ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers). A null or empty text has the end id alone; a null id
    stays null; repeated rows are pieces of their own; other columns are left out. With `placed`, PART and NTH are there too.
    A worker remembers up to twice `cache_words` words.
    """
    payload = T.StructField("ids", T.ArrayType(T.IntegerType(), False), False) if emit == "ids" else T.StructField("ids_crc32", T.LongType(), False)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), payload])
    if placed:
        schema = T.StructType([*schema, T.StructField(PART, T.IntegerType(), False), T.StructField(NTH, T.LongType(), False)])

    @tidy
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, places = encoder(vocabulary, cache_words), Places()
        for batch in batches:
            for part in runs_of(text_lengths(batch.column(1)), ENCODE_CHARS):
                rows, kept, held = [], [], []
                for k, ids in enumerate(encode(batch.column(1).slice(part.start, part.stop - part.start).to_pylist(), end_id)):
                    for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((k, n, start, length))
                        held.append(own if emit == "ids" else zlib.crc32(own))
                at, piece, start, length = np.array(rows, "i8").T
                if emit == "ids":
                    values = pa.array(np.frombuffer(b"".join(held), "<u4").astype("i4"))
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), values)
                else:
                    last = pa.array(held, pa.int64())
                kept = batch.column(0).slice(part.start, part.stop - part.start).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), last, *(places(length) if placed else ())], names=[f.name for f in schema])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, last rank + 1, first sequence, offset).

    The n-th piece of a run goes to the n-th sequence from the run's first, at the run's offset. Sequences
    that look alike are handled as one group, so the work depends on the number of lengths and not on that of
    documents: each length splits one group at most, and there are fewer than capacity^2 / 2 runs.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    rooms: list[int] = []
    runs, sequences = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, n, first = capacity, -(-left // (capacity // length)), sequences
                sequences += n
            each = room // length
            full = min(n, left // each)
            rest = min(left - full * each, each) if full < n else 0
            for k in range(each):
                for begin, count in ((first, full), (first + full, int(k < rest))):
                    if count:
                        runs.append((length, rank, rank + count, begin, capacity - room + k * length))
                        rank += count
            put(room - each * length, first, full)
            put(room - rest * length, first + full, int(rest > 0))
            put(room, first + full + (rest > 0), n - full - (rest > 0))
            left -= full * each + rest
    return runs


def best_fit_pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to `pieces` (doc_id, piece, length of 1 to `capacity`, any other columns).

    The histogram of lengths, at most `capacity` rows, is all that reaches the driver. Each piece has its
    rank among those of its length: its place among the pieces of the task that wrote it (PART and NTH, which are added and written here if `pieces` lacks them), after
    those of the tasks before. It takes the planned slot of that rank. Only the tasks' counts are shuffled. With PART and NTH, `pieces` must be a written table. An empty
    table gives none; pieces that are alike in all columns may swap slots.
    """
    spark = pieces.sparkSession
    columns = [c for c in pieces.columns if c not in (PART, NTH)]
    if columns == pieces.columns:
        at = columns.index("length")

        @tidy
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            places = Places()
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, *places(batch.column(at).to_numpy())], names=[*columns, PART, NTH])

        schema = T.StructType([*pieces.schema, T.StructField(PART, T.IntegerType()), T.StructField(NTH, T.LongType())])
        pieces = materialize(pieces.mapInArrow(place, schema), "pieces")
    counts = materialize(pieces.groupBy("length", PART).count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = [(int(x[0]), *x[1:]) for x in plan_best_fit(histogram, capacity)]
    plan = spark.createDataFrame(runs, "slot_length long, first_rank long, end_rank long, first_sequence long, slot_offset long")

    before = Window.partitionBy("length").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", PART, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_base"))
    ranked = pieces.join(bases, ["length", PART]).withColumn("rank", F.col("rank_base") + F.col(NTH))
    # the plan's size depends on the capacity alone
    slot = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank"))
    return ranked.join(F.broadcast(plan), slot).select(*columns, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("slot_offset").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, emit: str = "ids", id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """Tokenise, cut and pack `docs`: tokenize_pieces' columns with sequence_id and offset."""
    return best_fit_pack(materialize(tokenize_pieces(docs, vocabulary, capacity, end_id, emit, id_col, text_col, placed=True, cache_words=cache_words), "pieces"), capacity)
