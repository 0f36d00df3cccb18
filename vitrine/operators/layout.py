"""Layouts of a gallery, and what of one is in view."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.numbering import numbered, running_sum
from vitrine.sources.shared import materialize

#: Height of the bands that items are filed in.
CELL = 1000.0
#: Parts of a unit of length that widths are counted in.
MICRO = 1_000_000
POSITION = "x double, y double, width double, height double"


def grid_columns(container: float, item: float, gap: float) -> int:
    return max(1, int((container + gap) // (item + gap)))


def grid_layout(items: DataFrame, order: list[str], container: float, item: float, gap: float) -> DataFrame:
    """(id, x, y, width, height): equal squares, row by row, in the order of the columns `order` and then id.

    Rows are numbered inside each range of the sorted table and the ranges' counts are added up, so no task sorts all.
    """
    columns = grid_columns(container, item, gap)
    size = (container - (columns - 1) * gap) / columns
    return numbered(items.select("id", *order), [*order, "id"]).select(
        "id",
        (F.col("place") % columns * (size + gap)).alias("x"),
        (F.floor(F.col("place") / columns) * (size + gap)).cast("double").alias("y"),
        F.lit(size).alias("width"),
        F.lit(size).alias("height"),
    )


def masonry_layout(items: DataFrame, group: list[str], order: list[str], container: float, item: float, gap: float) -> DataFrame:
    """(group..., id, x, y, width, height): columns of one width; each item, in order, goes into the shortest (the leftmost of equals).

    items: id, aspect (width / height; 1 where it isn't above zero). A group is one gallery; where an item goes depends on all before it, so a
    gallery is laid out in one task, from a stream of batches, and keeps just its columns' heights.
    """


    n = grid_columns(container, item, gap)
    width = (container - (n - 1) * gap) / n
    schema = ", ".join(f"{c} {t}" for c, t in items.dtypes if c in (*group, "id")) + f", {POSITION}"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, heights = None, None
        for batch in batches:
            rows = []
            keys = list(zip(*(batch[c] for c in group), strict=True)) if group else [()] * len(batch)
            for key, aspect in zip(keys, batch["aspect"], strict=True):
                if key != held:
                    held, heights = key, np.zeros(n, np.float32)
                at = int(heights.argmin())
                tall = width / (aspect if aspect and aspect > 0 else 1.0)
                rows.append((at * (width + gap), float(heights[at]), width, tall))
                heights[at] += np.float32(tall + gap)
            spots = pd.DataFrame(rows, columns=["x", "y", "width", "height"], index=batch.index)
            yield pd.concat([batch[[c for c in batch.columns if c in (*group, "id")]], spots], axis=1)

    sorted_rows = items.repartition(*group).sortWithinPartitions(*group, *order, "id") if group else items.coalesce(1).sortWithinPartitions(*order, "id")
    kept = [c for c in items.columns if c in (*group, "id")]
    return sorted_rows.select(*kept, "aspect").mapInPandas(place, schema)


def justified_layout(items: DataFrame, group: list[str], order: list[str], container: float, row_height: float, gap: float, stretch: float = 1.2) -> DataFrame:
    """(group..., id, x, y, width, height): rows of one height each, filled with as many items as fit and scaled to the container's width.

    The last row isn't stretched where it would grow over `stretch` times. Widths add up in whole millionths, so sums don't depend on their order.

    Every item knows where the next row begins if one begins with it: at the first item whose end, in widths added up along the gallery, lies beyond its own beginning and
    a container; items and those bounds are sorted together and counted. The rows that are there are the ones that the first item's pointers lead to, followed by
    doubling: n rounds for 2^n rows. No task needs more than its range of the sorted items, however large a gallery is.
    """
    wide = F.round(row_height * F.coalesce(F.when(F.col("aspect") > 0, F.col("aspect")), F.lit(1.0)) * MICRO).cast("long")
    keys = {c: f"group_{n}" for n, c in enumerate(group)}
    listed = items.select(*([F.col(c).alias(k) for c, k in keys.items()] or [F.lit(0).alias("gallery")]), *(F.col(c).alias(f"order_{n}") for n, c in enumerate(order)), "id", wide.alias("wide"))
    by = list(keys.values()) or ["gallery"]
    room, space = round((container + gap) * MICRO), round(gap * MICRO)
    # before: widths and gaps of all items ahead, the galleries one after the other
    spread = materialize(running_sum(numbered(listed, [*by, *(f"order_{n}" for n in range(len(order))), "id"]).withColumn("step", F.col("wide") + space), ["place"], "step"), "spread")
    bounds = spread.groupBy(*by).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    ends = spread.select((F.col("before") + F.col("step")).alias("value"), F.lit(0).alias("kind"), F.lit(1).alias("one"), "place")
    asked = spread.select((F.col("before") + room).alias("value"), F.lit(1).alias("kind"), F.lit(0).alias("one"), "place")
    # an end counts as before a bound that it equals: the item still fits
    counted = running_sum(ends.unionByName(asked), ["value", "kind", "place"], "one", "fit").where("kind = 1").select("place", "fit")
    met = counted.join(_with_bounds(spread.select(*by, "place"), bounds, by), "place")
    jump = materialize(met.select("place", F.greatest("fit", F.col("place") + 1).alias("to"), "last").where("to <= last").drop("last"), "jump")
    begun = materialize(bounds.select(F.col("first").alias("place")), "begun")
    while not jump.isEmpty():
        begun = materialize(begun.unionByName(jump.join(begun, "place", "left_semi").select(F.col("to").alias("place"))).distinct(), "begun")
        jump = materialize(jump.join(jump.select(F.col("place").alias("to"), F.col("to").alias("next")), "to").select("place", F.col("next").alias("to")), "jump")
    marked = spread.join(begun.withColumn("begins", F.lit(1)), "place", "left").withColumn("begins", F.coalesce("begins", F.lit(0)))
    told = materialize(running_sum(marked, ["place"], "begins", "rows_before").withColumn("row", F.col("rows_before") + F.col("begins")), "rows")  # rows number from 1
    rows = told.groupBy(*by, "row").agg(F.min("before").alias("start"), F.sum("wide").alias("total"), F.count(F.lit(1)).alias("n"), F.max("place").alias("end"))
    rows = _with_bounds(rows, bounds, by)
    scale = (F.lit(container) - (F.col("n") - 1) * gap) * MICRO / F.col("total")
    rows = rows.withColumn("scale", F.when((F.col("end") == F.col("last")) & (scale > stretch), 1.0).otherwise(scale))
    rows = materialize(rows.withColumn("tall", F.round((row_height * F.col("scale") + gap) * MICRO).cast("long")).select(*by, "row", "start", "scale", "tall"), "scaled")
    high = materialize(running_sum(rows, ["row"], "tall", "above"), "high")
    tops = high.groupBy(*by).agg(F.min("above").alias("top"))
    placed_rows = _with_bounds(high, tops, by).select("row", "start", "scale", ((F.col("above") - F.col("top")) / MICRO).alias("y"))
    nth = F.col("place") - F.col("row_first")
    firsts = told.groupBy("row").agg(F.min("place").alias("row_first"))
    out = told.join(placed_rows.join(firsts, "row"), "row")
    x = (F.col("before") - F.col("start") - nth * space) * F.col("scale") / MICRO + nth * gap
    kept = [c for c in items.columns if c in (*group, "id")]
    return out.select(*(F.col(keys[c]).alias(c) if c in keys else F.col(c) for c in kept), x.alias("x"), "y", (F.col("wide") * F.col("scale") / MICRO).alias("width"), (row_height * F.col("scale")).alias("height"))


def _with_bounds(rows: DataFrame, bounds: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with the columns of `bounds` that their gallery has; null is a gallery like any other."""
    named = bounds.select(*(F.col(c).alias(f"of_{c}") for c in by), *(c for c in bounds.columns if c not in by))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    both = same[0]
    for one in same[1:]:
        both &= one
    return rows.join(named, both).drop(*(f"of_{c}" for c in by))


def visible(positions: DataFrame, views: DataFrame, buffer: float, cell: float = CELL) -> DataFrame:
    """(view_id, id, x, y, width, height, place): what is in each view (view_id, top, height) or within `buffer` of it, from the top, then the left.

    Items and views meet by the bands that they touch, an equi-join, and are compared exactly after that.
    """

    def bands(low, high):
        return F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell)))

    first, last = F.greatest(F.lit(0.0), F.col("top") - buffer), F.col("top") + F.col("view_height") + buffer
    asked = views.select("view_id", "top", F.col("height").alias("view_height")).select("view_id", first.alias("first"), last.alias("last")).withColumn("band", bands(F.col("first"), F.col("last")))
    filed = positions.withColumn("band", bands(F.col("y"), F.col("y") + F.col("height")))
    met = asked.join(filed, "band").where((F.col("y") + F.col("height") > F.col("first")) & (F.col("y") < F.col("last")))
    found = met.groupBy("view_id", "id").agg(*(F.first(c).alias(c) for c in ("x", "y", "width", "height")))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("view_id").orderBy("y", "x", "id")))
