"""Trees by parent links: subtrees, closures, ordered listings and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.paths import ancestors, basename, is_under, parent
from vitrine.operators.numbering import numbered
from vitrine.sources.shared import few, materialize

#: Levels below a folder that a search criterion follows; other recursion has no limit.
DEPTH = 50


def subtree(nodes: DataFrame, root: int, depth: int | None = None) -> DataFrame:
    """(id) of `root`, if it is a row, and all below it, or `depth` levels of that.

    By doubling: every node knows whether it meets `root` within 2^k steps up, and where it is then, so n rounds follow 2^n levels. Nodes that have met
    it or have come to a top go no further. Rounds are written to the shared folder. Who is in a loop of parents, or below one, stops after as many levels as there are nodes.
    """
    links = materialize(nodes.select("id", "parent_id"), "links")
    to, met = F.col("parent_id"), F.when(F.col("id") == root, 0).when(F.col("parent_id") == root, 1)
    way = materialize(links.select("id", F.when(met.isNull(), to).alias("to"), met.alias("distance")), "way")
    if links.where(F.col("id") == root).isEmpty():
        return links.select("id").limit(0)
    most = links.count() if depth is None else depth
    step = 1
    while step < most and not way.where("to IS NOT NULL").isEmpty():
        above = way.select(F.col("id").alias("to"), F.col("to").alias("next"), (F.col("distance") + step).alias("far"))
        jumped = way.where("to IS NOT NULL").join(few(above), "to", "left")
        moved = jumped.select("id", F.when(F.col("far").isNull(), F.col("next")).alias("to"), F.col("far").alias("distance"))
        way = materialize(way.where("to IS NULL").unionByName(moved), "way")
        step *= 2
    return way.where(F.col("distance").isNotNull() if depth is None else F.col("distance") <= depth).select("id").distinct()


def closure(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, distance): every node with itself and all above it, by doubling.

    Round k joins each node's place 2^k levels up with what that place reaches, so n rounds follow 2^n - 1 levels; when no node has one so
    far up, or the levels are as many as the nodes, all is found. Only places that some node has are looked up, so a wide tree's round is told by few rows. Rounds are written to the shared folder. A loop of parents gives each pair with its least distance. Parents that aren't rows end a way.
    """
    nodes = materialize(nodes.select("id", "parent_id"), "nodes")
    up = nodes.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("to"))
    reach = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    for k in range(nodes.count().bit_length()):
        places = materialize(up.select("to").distinct(), "places")
        if places.isEmpty():
            break
        asked = few(places)
        above = few(materialize(reach.select(F.col("id").alias("to"), "ancestor", (F.col("distance") + 2**k).alias("distance")).join(asked, "to", "left_semi"), "above"))
        more = reach.unionByName(up.join(above, "to").select("id", "ancestor", "distance"))
        reach = materialize(more.groupBy("id", "ancestor").agg(F.min("distance").alias("distance")), "reach")  # a loop would come again each round
        further = few(materialize(up.select(F.col("id").alias("to"), F.col("to").alias("next")).join(asked, "to", "left_semi"), "further"))
        up = materialize(up.join(further, "to").select("id", F.col("next").alias("to")).distinct(), "up")
    return reach


def tree_rows(nodes: DataFrame, order: list[str], depth: int | None = None) -> DataFrame:
    """(id, depth, place): the tree depth first, siblings in the order of the columns `order`, then id.

    Nodes whose parent isn't a row are roots. Each node's way from the root, as its place among its siblings at every level, sorts the whole.
    """
    known = nodes.select(F.col("id").alias("known"))
    own = nodes.join(known, F.col("parent_id") == F.col("known"), "left").select("id", F.col("known").alias("parent_id"), *order)
    sibling = F.row_number().over(Window.partitionBy("parent_id").orderBy(*order, "id"))
    placed = materialize(own.select("id", "parent_id", F.format_string("%012d", sibling).alias("own")), "siblings")
    ways = closure(placed).join(placed.select(F.col("id").alias("ancestor"), "own"), "ancestor")
    way = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("up"), "own"))), lambda x: x["own"]), "/")
    told = ways.groupBy("id").agg(F.max("distance").alias("depth"), way.alias("way")).where(F.lit(True) if depth is None else F.col("depth") <= depth)
    return numbered(told, ["way"]).select("id", "depth", "place")


def roots(folders: DataFrame) -> DataFrame:
    """(id, path) of marked roots and of folders without a parent."""
    return folders.where(F.col("is_root") | F.col("parent_id").isNull()).select("id", "path")


def under_path(folders: DataFrame, root: str) -> DataFrame:
    """(id, path) of the folder at `root` and of those below it, by path."""
    return folders.where(is_under(F.col("path"), root)).select("id", "path")


def missing_folders(paths: DataFrame, folders: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, name, parent_path) of every folder on the way to `paths` that `folders` doesn't have."""
    wanted = paths.select(F.explode(ancestors(F.col(path_col))).alias("path")).distinct()
    new = wanted.join(folders.select("path"), "path", "left_anti")
    return new.select("path", basename(F.col("path")).alias("name"), parent(F.col("path")).alias("parent_path"))


def nearest_ancestor(paths: DataFrame, folders: DataFrame, path_col: str = "path") -> DataFrame:
    """(path, parent_id): the closest folder strictly above each path that `folders` has, or null."""
    ways = paths.select(F.col(path_col).alias("path")).distinct().select("path", F.posexplode(ancestors(F.col("path"))).alias("level", "above")).where("above <> path")
    met = ways.join(folders.select(F.col("path").alias("above"), "id"), "above")
    best = met.groupBy("path").agg(F.max_by("id", "level").alias("parent_id"))
    return paths.select(F.col(path_col).alias("path")).distinct().join(best, "path", "left")


def forest_of(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Every node with its parent (null for roots and orphans) and its count from `counts` (id, count), or 0."""
    known = nodes.select(F.col("id").alias("known"))
    own = nodes.join(known, F.col("parent_id") == F.col("known"), "left")
    return own.join(counts, "id", "left").select("id", F.col("known").alias("parent_id"), "name", F.coalesce("count", F.lit(0)).alias("count"))
