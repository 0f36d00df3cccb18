"""Trees as intervals: every node has a number, and a subtree is the range of numbers from its root's on.

A table whose rows carry their folder's number finds a whole subtree by `place BETWEEN first AND last`, which reaches the scan however deep the tree is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from vitrine.operators.numbering import running_sum
from vitrine.sources.shared import few, materialize

#: Most nodes of a block, which one task holds at a time.
BLOCK = 1 << 17


def _jumps(links: DataFrame, n: int) -> tuple[list[DataFrame], bool]:
    """Tables (id, to), the k-th with every node's place 2^k levels up, as long as any node has one; and whether some never end."""
    jumps: list[DataFrame] = []
    up = materialize(links, "up")
    while not up.isEmpty():
        jumps.append(up)
        if 1 << (len(jumps) - 1) >= n:
            return jumps, True
        up = materialize(up.join(few(up.select(F.col("id").alias("to"), F.col("to").alias("next"))), "to").select("id", F.col("next").alias("to")), "up")
    return jumps, False


def _leaders(jumps: list[DataFrame]) -> DataFrame:
    """(id, leader) of the nodes in loops, with the smallest id of each one's loop. After as many steps as there are nodes everyone left is in a loop."""
    least = jumps[0].select("id", F.least("id", "to").alias("leader"))
    for up in jumps[1:]:
        far = least.select(F.col("id").alias("to"), F.col("leader").alias("far"))
        least = materialize(least.join(up.join(few(far), "to").select("id", "far"), "id", "left").select("id", F.least("leader", "far").alias("leader")), "leaders")
    inside = few(materialize(jumps[-1].select(F.col("to").alias("id")).distinct(), "inside"))
    return materialize(least.join(inside, "id", "left_semi"), "leaders")


def _parents(ids: pa.ChunkedArray, parents: pa.ChunkedArray) -> np.ndarray:
    """The place of each row's parent among the rows of a block, or the number of rows where it isn't there; and that number once more, for the row that stands for none."""
    found = pc.fill_null(pc.index_in(parents, value_set=ids.combine_chunks(), skip_nulls=True), len(ids))
    return np.append(found.to_numpy().astype(np.int64), len(ids))


def _local(rows: pa.Table, parent: str) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a block are heads, and each row's parent as _parents() tells, none for heads."""
    head = pc.equal(rows["id"], rows["head"]).to_numpy()
    up = _parents(rows["id"], rows[parent])
    up[:-1][head] = len(head)
    return head, up


def _heads(up: np.ndarray) -> np.ndarray:
    """Each row's topmost row above it in the block, itself included. A loop is cut above its first row."""
    n = len(up) - 1
    far, least, steps = up, np.arange(n + 1), 1
    while steps < 2 * n and (far < n).any():
        least, far, steps = np.minimum(least, least[far]), far[far], 2 * steps
    inside = np.unique(far[far < n])  # who still has someone above is in a loop or below one
    head = np.where(up < n, up, np.arange(n + 1))
    firsts = inside[least[inside] == inside]
    head[firsts] = firsts
    while (head != head[head]).any():
        head = head[head]
    return head[:n]


def _above(up: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of `own` over each row and all above it, in a block without loops."""
    total = np.append(own, 0)
    while (up < len(own)).any():
        total, up = total + total[up], up[up]
    return total[:-1]


def _below(up: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The sum of `own` over each row and all below it, in a block without loops."""
    total = np.append(own, 0)
    while (live := np.flatnonzero(up < len(own))).size:
        more = np.zeros_like(total)
        np.add.at(more, up[live], total[live])
        total, up = total + more, up[up]
    return total[:-1]


def _gathered(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    """Tables of `block` rows, and one of what is left."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = block - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """`nodes` with the columns `block` and `head`: ranges of ids, of at most `block` rows, each named by its first id, and the topmost node that a walk up from each one reaches in its range.

    Only heads have parents in other blocks. Nodes made one after another have few heads; where ids tell nothing about the tree, most nodes are heads.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, block):
            ids = rows["id"].combine_chunks()
            heads = ids.take(pa.array(_heads(_parents(rows["id"], rows["parent_id"]))))
            yield from rows.append_column("block", pa.repeat(ids[0], len(ids))).append_column("head", heads).to_batches()

    kind = nodes.schema["id"].dataType
    ranged = nodes.where("id IS NOT NULL").repartitionByRange("id").sortWithinPartitions("id")
    return ranged.mapInArrow(told, StructType([*nodes.schema.fields, StructField("block", kind), StructField("head", kind)]))


def _sizes(held: DataFrame, marks: DataFrame, order: list[str]) -> DataFrame:
    """(id, block, head, parent, size, `order`) of all nodes in blocks, from `marks` (id, met, hung): whether a head's parent is a node, and the sizes of all heads of other blocks whose parent a node is."""

    def told(rows: pa.Table) -> pa.Table:
        head, up = _local(rows, "parent_id")
        size = _below(up, 1 + rows["hung"].to_numpy())
        known = pc.or_(pc.invert(pa.array(head)), rows["met"].combine_chunks())
        parents = rows["parent_id"].combine_chunks()
        parent = pc.if_else(known, parents, pa.scalar(None, parents.type))
        return pa.table({"id": rows["id"], "block": rows["block"], "head": rows["head"], "parent": parent, "size": pa.array(size)} | {c: rows[c] for c in order})

    of = held.schema
    fields = [of["id"], of["block"], of["head"], StructField("parent", of["parent_id"].dataType), StructField("size", LongType()), *(of[c] for c in order)]
    marked = held.join(marks, "id", "left").withColumns({"met": F.coalesce("met", F.lit(False)), "hung": F.coalesce("hung", F.lit(0))})
    return marked.groupBy("block").applyInArrow(told, StructType(fields))


def _ways(summed: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, head, size, start, way, steps) of `summed` (id, block, head, parent, size, before: the sizes before it in the order of siblings).

    `start` is what lies before a node's first child, and `way` how much larger its number is than its head's, `steps` levels up. `firsts` (id, least) has the least `before` of heads of other blocks whose parent a node is.
    """

    def told(rows: pa.Table) -> pa.Table:
        head, up = _local(rows, "parent")
        before = rows["before"].to_numpy()
        start = np.append(rows["least"].to_numpy(), 0)
        np.minimum.at(start, up[:-1], before)
        way = _above(up, np.where(head, 0, before - start[up[:-1]] + 1))
        steps = _above(up, np.where(head, 0, 1))
        return pa.table({"id": rows["id"], "head": rows["head"], "size": rows["size"], "start": pa.array(start[:-1]), "way": pa.array(way), "steps": pa.array(steps.astype(np.int32))})

    of = summed.schema
    fields = [of["id"], of["head"], *(StructField(c, LongType()) for c in ("size", "start", "way")), StructField("steps", IntegerType())]
    marked = summed.join(firsts, "id", "left").withColumn("least", F.coalesce("least", F.lit((1 << 63) - 1)))
    return marked.groupBy("block").applyInArrow(told, StructType(fields))


def _summed_below(own: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(id, size): `own` (id, size) summed over each node and all below it, by doubling."""
    sizes = materialize(own, "sizes")
    for up in jumps:
        more = up.join(few(sizes), "id").groupBy(F.col("to").alias("id")).agg(F.sum("size").alias("more"))
        sizes = materialize(sizes.join(more, "id", "left").select("id", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "sizes")
    return sizes


def _summed_above(own: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(id, place, depth): `own` (id, place, depth) summed over each node and all above it, by doubling."""
    numbers = materialize(own, "numbers")
    for up in jumps:
        above = up.join(few(numbers.select(F.col("id").alias("to"), F.col("place").alias("more"), F.col("depth").alias("deeper"))), "to").select("id", "more", "deeper")
        numbers = materialize(numbers.join(above, "id", "left").select("id", (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth")), "numbers")
    return numbers


def _numbers(held: DataFrame, links: DataFrame, jumps: list[DataFrame], order: list[str]) -> DataFrame:
    """(id, place, first, last, depth) of a forest in blocks, `held`, whose heads have the parents and these the heads that `links` (id, parent, to) has; `jumps` are those from heads to heads.

    A node's size is summed over its descendants and its number over its ancestors: inside blocks by the task that has the block, from head to head by doubling.
    """
    sizes = _summed_below(held.groupBy(F.col("head").alias("id")).agg(F.count(F.lit(1)).alias("size")), jumps)
    hung = links.join(few(sizes), "id").select(F.col("parent").alias("id"), F.lit(False).alias("met"), F.col("size").alias("hung"))
    marks = hung.unionByName(links.select("id", F.lit(True).alias("met"), F.lit(0).cast("long").alias("hung")))
    marks = materialize(marks.groupBy("id").agg(F.max("met").alias("met"), F.sum("hung").alias("hung")), "marks")
    summed = running_sum(_sizes(held, few(marks), order), ["parent", *order, "id"], "size", "before").drop(*order)
    tops = materialize(summed.where("id = head").select("id", "parent", "before"), "tops")
    hanging = tops.where("parent IS NOT NULL")
    firsts = materialize(hanging.groupBy(F.col("parent").alias("id")).agg(F.min("before").alias("least")), "firsts")
    ways = materialize(_ways(summed, few(firsts)), "ways")
    met = ways.select(F.col("id").alias("parent"), "start", "way", "steps").join(few(hanging), "parent")
    own = met.select("id", (F.col("before") - F.col("start") + 1 + F.col("way")).alias("place"), (F.col("steps") + 1).alias("depth"))
    own = own.unionByName(tops.where("parent IS NULL").select("id", F.col("before").alias("place"), F.lit(0).alias("depth")))
    told = _summed_above(own, jumps).select(F.col("id").alias("head"), F.col("place").alias("top"), "depth")
    place = F.col("top") + F.col("way")
    return ways.join(few(told), "head").select("id", place.alias("place"), place.alias("first"), (place + F.col("size") - 1).alias("last"), (F.col("depth") + F.col("steps")).alias("depth"))


def intervals(nodes: DataFrame, order: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(id, place, first, last, depth): a number for every node of `nodes` (id, parent_id), depth first, from 0; below a node, itself included, are those from `first` to `last`.

    Siblings follow the columns `order` and then their ids. Nodes whose parent isn't a row are roots, in the same order. Ranges of at most `block` ids are numbered by a task each; what leads from
    range to range is so by n rounds of joins, each written to the shared folder, for up to 2^n ranges on a way. A loop of parents is numbered from its smallest id, whose parent is left out, and all
    in the loop have the loop's whole range. Ids must differ.
    """
    named = {f"order_{k}": F.col(c) for k, c in enumerate(order or [])}
    rows = nodes.select("id", F.col("parent_id").try_cast(nodes.schema["id"].dataType).alias("parent_id"), *(c.alias(n) for n, c in named.items()))
    held = materialize(_in_blocks(rows, block), "nodes")
    heads = materialize(held.where("id = head AND parent_id IS NOT NULL").select("id", F.col("parent_id").alias("parent")), "heads")
    links = materialize(held.select(F.col("id").alias("parent"), F.col("head").alias("to")).join(few(heads), "parent").select("id", "parent", "to"), "links")
    jumps, loops = _jumps(links.select("id", "to"), links.count() + 1)
    if not loops:
        return _numbers(held, links, jumps, list(named))
    caught = held.join(few(jumps[-1].select(F.col("id").alias("head"))), "head", "left_semi").select("id", F.col("parent_id").alias("to"))  # in loops or below them
    leaders = _leaders(_jumps(caught, caught.count() + 1)[0])
    first = leaders.where("id = leader").select("id", F.lit(True).alias("cut"))
    cut = held.join(few(first), "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("parent_id")).alias("parent_id"), *named)
    told = intervals(cut, list(named), block)
    whole = leaders.where("id <> leader").join(told.select(F.col("id").alias("leader"), F.col("first").alias("whole_first"), F.col("last").alias("whole_last")), "leader").drop("leader")
    met = told.join(whole, "id", "left")
    return met.select("id", "place", F.coalesce("whole_first", "first").alias("first"), F.coalesce("whole_last", "last").alias("last"), "depth")


def inside(spans: DataFrame, root: int, place: str = "place") -> Column:
    """The condition on the column `place` that it lies at or below the node `root` of intervals(); false for an unknown one."""
    found = spans.where(F.col("id") == root).select("first", "last").first()  # two numbers
    return F.col(place).between(found["first"], found["last"]) if found else F.lit(False)


def placed(rows: DataFrame, spans: DataFrame, node_col: str, place_col: str) -> DataFrame:
    """`rows` with their node's number, in order of it, so that files and row groups hold ranges of numbers; null where the node is unknown."""
    met = rows.join(spans.select(F.col("id").alias(node_col), F.col("place").alias(place_col)), node_col, "left")
    return met.repartitionByRange(place_col).sortWithinPartitions(place_col).select(*rows.columns, place_col)


def counts_below(spans: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, count) of every node: the sum of `counts` (id, count) over it and all below it.

    Counts are summed along the numbers; a subtree's sum is what has been summed at its end less what there was before it. Both are looked up among the up to `block` rows, in order of
    their numbers, that a task holds; what isn't there is joined. Rows are one a node, however deep it lies.
    """
    own = spans.join(counts.select("id", F.col("count").alias("own")), "id", "left").select("id", "place", "first", "last", F.coalesce("own", F.lit(0)).alias("own"))
    summed = materialize(running_sum(own, ["place"], "own", "before"), "sums")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches, block):
            places = rows["place"].combine_chunks()
            start = pc.take(rows["before"], pc.index_in(rows["first"], value_set=places))
            end = pc.take(pc.add(rows["before"], rows["own"]), pc.index_in(rows["last"], value_set=places))
            yield from rows.select(["id", "first", "last"]).append_column("start", start).append_column("end", end).to_batches()

    of = summed.schema
    met = materialize(summed.mapInArrow(told, StructType([of["id"], of["first"], of["last"], StructField("start", LongType()), StructField("end", LongType())])), "met")
    asked = met.where("start IS NULL").select(F.col("first").alias("place")).unionByName(met.where("end IS NULL").select(F.col("last").alias("place")))
    far = few(materialize(summed.join(few(materialize(asked.distinct(), "asked")), "place").select("place", "before", (F.col("before") + F.col("own")).alias("after")), "far"))
    met = met.join(far.select(F.col("place").alias("first"), "before"), "first", "left").join(far.select(F.col("place").alias("last"), "after"), "last", "left")
    return met.select("id", (F.coalesce("end", "after") - F.coalesce("start", "before")).alias("count"))
