"""Running numbers over a sorted table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vitrine.sources.shared import fresh, materialize


def numbered(rows: DataFrame, order: list[str] | list[Column], name: str = "place") -> DataFrame:
    """`rows` with their number, from 0, in the order of the columns `order` (names: ascending, nulls first; columns: as they say; rows alike in all of them in any order).

    Ranges of the order are sorted and written on their own; a row's number is its range's start, from the ranges' counts, and its place in the range.
    """
    ranged = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    met = ranged.withColumn("part", part).join(F.broadcast(starts), "part")  # a row for each partition
    return met.withColumn(name, F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "at", "start")


def running_sum(rows: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """`rows` with the sum of `value` (a whole number, not null) over all rows before them in the order of the columns `order`, as numbered() sorts.

    Sums run inside each range as it is sorted and written; a range starts from what the ones before it add up to.
    """
    part, start, own = (fresh(rows.columns, c) for c in ("part", "start", "own"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            values = batch.column(value).to_numpy().astype(np.int64)
            sums = total + np.cumsum(values)
            yield batch.append_column(own, pa.array(sums - values))
            total = sums[-1] if len(sums) else total

    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    ranged = materialize(parted.mapInArrow(told, StructType([*parted.schema.fields, StructField(own, LongType())])), "ranged")
    starts = ranged.groupBy(part).agg(F.sum(value).alias(start)).select(part, F.coalesce(F.sum(start).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    met = ranged.join(F.broadcast(starts), part)  # a row for each partition
    return met.withColumn(name, F.col(start) + F.col(own)).drop(part, start, own)
