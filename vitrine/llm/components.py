"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.sources.shared import Scratch, materialize


def components(links: DataFrame, work: Scratch | None = None) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling, and
    links the ends; at least half of the linked nodes go in each round. Only counts of changes reach the driver, and the tables of
    a round are written to the shared folder, as part of `work` if it is given. Loops and repeated links do no harm; no links give no rows.
    """
    table = work.table if work else materialize
    rounds: list[DataFrame] = []
    links = links.select("a", "b").where("a <> b")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "ends")
        if ends.isEmpty():
            break
        while True:
            above = ends.select(F.col("node").alias("root"), F.col("root").alias("above"))
            ends = table(ends.join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "ends")
            if ends.where("moved").isEmpty():
                break
        ends = ends.drop("moved")
        rounds.append(ends)
        a, b = ends.toDF("a", "root_a"), ends.toDF("b", "root_b")
        left = links.join(a, "a").join(b, "b").where("root_a <> root_b")
        links = table(left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        found = found.join(later.toDF("root", "end"), "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return found
