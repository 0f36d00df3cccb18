"""How filters interact: what each removes at its place in every order, and what it alone would."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.workers import tidy
from vitrine.sources.shared import materialize

_SPACE = r"[\x20\x09-\x0D]+"


def quality_filters() -> dict[str, Column]:
    """The conditions under which a text (columns text, and words: its array of words) fails, by letter; E, for duplicates, comes after them."""
    text, words = F.col("text"), F.col("words")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _mask(conditions: dict[str, Column]) -> Column:
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0)).cast("int")


def repeats_marked(sorted_rows: DataFrame) -> DataFrame:
    """(id, part, mask, again, fp, digest) of rows (id, part, text, fp, mask) that lie in ranges sorted by fp, text and id.

    again: the row's text is that of its predecessor and its id isn't the first with that text, as far as the range tells. A text can begin in an
    earlier range, so rows of a range's first fingerprint that aren't `again` carry their text's digest; for each text of a range's last fingerprint
    an edge row (mask -1) tells digest and first id. Both are as few as the ranges, but for repeated ids.
    """
    id_type = sorted_rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("part string, mask int, again boolean, fp long, digest binary").fields])

    def digest(text: str) -> bytes:
        return hashlib.sha256(text.encode()).digest()

    @tidy
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = tail_fp = last_text = first = None
        tail: list[tuple[bytes, object]] = []  # texts of the last fingerprint, with their first ids
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, part, text, fp, mask = batch.columns
            prints = fp.to_numpy()
            same = np.zeros(len(prints), bool)
            same[1:] = (prints[1:] == prints[:-1]) & pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False)
            same[0] = head is not None and prints[0] == tail_fp and text[0].as_py() == last_text
            at = np.maximum.accumulate(np.where(same, 0, np.arange(1, len(same) + 1)))
            firsts = pa.concat_arrays([pa.array([first], ids.type), ids]).take(pa.array(at))  # the id with which each row's text began
            alike = pc.or_(pc.fill_null(pc.equal(ids, firsts), False), pc.and_(pc.is_null(ids), pc.is_null(firsts))).to_numpy(zero_copy_only=False)
            again = same & ~alike
            head = int(prints[0]) if head is None else head
            waits = np.flatnonzero((prints == head) & ~again)
            digests: list[bytes | None] = [None] * len(prints)
            for k in waits:
                digests[k] = digest(text[k].as_py())
            if prints[-1] != tail_fp:
                tail, tail_fp = [], int(prints[-1])
            tail += [(digest(text[k].as_py()), ids[k].as_py()) for k in np.flatnonzero((prints == tail_fp) & ~same)]
            last_text, first = text[-1].as_py(), firsts[-1].as_py()
            yield pa.RecordBatch.from_arrays([ids, part, mask, pa.array(again), fp, pa.array(digests, pa.binary())], names=schema.names)
        if tail:
            n = len(tail)
            columns = [pa.array([x[1] for x in tail], ids.type), pa.nulls(n, pa.string()), pa.array([-1] * n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array([tail_fp] * n), pa.array([x[0] for x in tail], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return sorted_rows.select("id", "part", "text", "fp", "mask").mapInArrow(mark, schema)


def failure_masks(docs: DataFrame, conditions: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every row: a bit for each condition its text fails, and the next one if its text is also that of a smaller id.

    Rows go into ranges by fingerprint and id (and a running number, so that rows alike don't stay together), and are sorted there by fingerprint,
    whole text and id: copies of a text lie side by side however many there are. A null id is smaller than others; rows of one id aren't each other's copies.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(text_col, F.lit("")).alias("text"))
    ranged = rows.select("*", F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("row")).repartitionByRange("fp", "id", "row").sortWithinPartitions("fp", "text", "id")
    masked = ranged.withColumn("words", F.filter(F.split("text", _SPACE), lambda w: w != "")).withColumn("mask", _mask(conditions))
    told = materialize(repeats_marked(masked), "masks")
    begun = told.where("mask = -1").groupBy("fp", "digest").agg(F.min(F.struct("id")).alias("begun"))  # a row or so for each range
    met = told.where("mask >= 0").join(F.broadcast(begun), ["fp", "digest"], "left")
    again = F.col("again") | (F.col("begun").isNotNull() & ~F.col("begun.id").eqNullSafe(F.col("id")))
    return met.select("id", "part", (F.col("mask") + F.when(again, 1 << len(conditions)).otherwise(0)).alias("mask"))


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column] | None = None, duplicates: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row for each part, order of the filters and step.

    `conditions` (by default quality_filters()) say when a text fails; the filter `duplicates` fails texts of a smaller id. What `labels` (id_col, quality, toxic)
    says of an id in any row of it counts: quality 1 makes it good, toxic 1 toxic. A part is a value of `part_col` (null: the empty string).

    Null texts are empty ones. Rows alike in id and text aren't copies of each other and count each. No rows, no parts. Counts are summed by part and
    mask, of which there are 2 to the number of filters, before anything is told for orders; up to 7 filters (5,040 orders) are sensible.
    """
    conditions = quality_filters() if conditions is None else conditions
    letters = [*conditions, duplicates]
    judged = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).where("good = 1 OR toxic = 1")
    masks = failure_masks(docs, conditions, id_col, text_col, part_col).join(judged, "id", "left")
    held = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return _by_order(held, letters)


def _by_order(held: DataFrame, letters: list[str]) -> DataFrame:
    """The audit's rows from counters (part, mask, n, good, toxic)."""
    k = len(letters)
    turns = [(before, f) for f in range(k) for before in range(1 << k) if not before >> f & 1]
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for b, f in turns))).alias("turn")
    spread = held.select("*", each).select("part", "mask", "n", "good", "toxic", "turn.*")
    late, fails = F.col("mask").bitwiseAND(F.col("before")) != 0, F.col("mask").bitwiseAND(F.col("bit")) != 0

    def total(n: str, where: Column, name: str) -> Column:
        return F.sum(F.when(where, F.col(n)).otherwise(0)).alias(name)

    turned = spread.groupBy("part", "before", "filter").agg(
        total("n", ~late & ~fails, "kept"),
        total("n", ~late & fails, "removed"),
        total("n", late & fails, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", ~late & fails, "good_lost"),
        total("toxic", ~late & fails, "toxic_lost"),
    )
    times = F.element_at(F.array(*(F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k))), F.bit_count("before") + 1)  # orders with these before the filter
    shares = turned.groupBy("part", "filter").agg(F.sum(F.col("removed") * times).alias("shapley"))
    orders = [("".join(letters[f] for f in o), i + 1, sum(1 << f for f in o[:i]), f) for o in permutations(range(k)) for i, f in enumerate(o)]
    listed = held.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    told = turned.join(shares, ["part", "filter"]).join(F.broadcast(listed), ["before", "filter"])
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return told.select("part", "filter_order", "step", *(F.col(n).cast("long").alias(n) for n in names))
