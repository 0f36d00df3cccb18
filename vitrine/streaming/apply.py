"""Coalesced changes applied to a catalog, always in the order renames, removals, folders, files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.paths import ancestors, basename, parent
from vitrine.operators import writes
from vitrine.sources.catalog import Catalog
from vitrine.sources.shared import materialize


@dataclass(frozen=True)
class Applied:
    """catalog: after the batch. changes: what happened (stats.CHANGES). pending: removed paths that wait for their grace. refresh: whether folders changed."""

    catalog: Catalog
    changes: DataFrame
    pending: DataFrame
    refresh: bool


def _moved(table: DataFrame, heads: DataFrame) -> DataFrame:
    """`table` (id, path, ..) with what is at or below one of `heads` (path, to_path) under its new head, that of the closest one above, and whether it has moved."""
    named = heads.select(F.col("path").alias("head"), F.col("to_path").alias("new_head"))
    ways = table.select("id", "path", F.explode(ancestors(F.col("path"))).alias("head")).join(named, "head")
    best = ways.groupBy("id").agg(F.max_by(F.struct("head", "new_head"), F.char_length("head")).alias("m"))
    met = table.join(best, "id", "left")
    path = F.when(F.col("m").isNotNull(), F.concat("m.new_head", F.substr("path", F.char_length("m.head") + 1))).otherwise(F.col("path"))
    return met.withColumn("path", path).withColumn("has_moved", F.col("m").isNotNull()).drop("m")


def _renamed(catalog: Catalog, heads: DataFrame) -> Catalog:
    """After `heads` (path, to_path) all at once; folders that come to one path are merged into the one that was there, or else the smallest id."""
    folders, images = materialize(_moved(catalog.folders, heads), "folders"), _moved(catalog.images, heads)
    keep = folders.groupBy("path").agg(F.min(F.struct("has_moved", "id")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.col("keep.id").alias("kept_id"))
    merged = materialize(folders.join(keep, "path").where("id <> kept_id").select(F.col("id").alias("gone_id"), "kept_id"), "merged")
    own = heads.select(F.col("to_path").alias("path"), F.lit(True).alias("own")).distinct()
    named = folders.join(own, "path", "left").withColumn("name", F.when(F.col("own") & F.col("has_moved"), basename(F.col("path"))).otherwise(F.col("name")))
    left = named.join(merged.select(F.col("gone_id").alias("id")), "id", "left_anti")

    def remapped(table: DataFrame, column: str) -> DataFrame:
        met = table.join(merged.withColumnRenamed("gone_id", column), column, "left")
        return met.withColumn(column, F.coalesce("kept_id", column))

    return catalog.put(folders=remapped(left, "parent_id").select(catalog.folders.columns), images=remapped(images, "folder_id").select(catalog.images.columns))


def rename_folders(catalog: Catalog, renames: DataFrame) -> tuple[Catalog, DataFrame]:
    """After all of `renames` (path, to_path) at once, and those whose folder the catalog doesn't have.

    Every path below a renamed folder takes the new head of the closest one above it, by a join on the path's ancestors. Where the new path is a folder already, and none that is renamed itself, the two are
    merged first, so what a merged folder has goes wherever the other goes. Other renames speak of the paths before any of them, so two folders may change places. Folders that come to one path are merged at any
    depth: the one that was there, or else the smallest id, takes the others' children and images. A folder keeps its parent. Images that come to one path all stay; violations() tells them. Of
    several renames of one path the greatest new one counts.
    """
    renames = renames.groupBy("path").agg(F.max("to_path").alias("to_path"))
    known = materialize(renames.join(catalog.folders.select("path"), "path", "left_semi").where("path <> to_path"), "renames")
    unknown = renames.join(catalog.folders.select("path"), "path", "left_anti")
    if known.isEmpty():
        return catalog, unknown  # no path changes, so none is walked
    there = catalog.folders.select(F.col("path").alias("to_path"))
    merges = materialize(known.join(there, "to_path", "left_semi").join(known.select(F.col("path").alias("to_path")), "to_path", "left_anti"), "merges")
    plain = known.join(merges.select("path"), "path", "left_anti").select("path", "to_path")
    if not merges.isEmpty():
        merges = merges.select("path", "to_path")
        catalog = _renamed(catalog, merges)
        # a renamed folder inside a merged one is where that went by now
        plain = materialize(_moved(plain.select(F.col("path").alias("id"), "path", "to_path"), merges).select("path", "to_path"), "plain")
    return _renamed(catalog, plain), unknown


def _with_folders(catalog: Catalog, paths: DataFrame) -> Catalog:
    done = writes.ensure_folders(catalog, paths)
    return done.put(folders=materialize(done.folders, "folders"))


def apply_batch(catalog: Catalog, ops: DataFrame, files: DataFrame, on_disk: DataFrame) -> Applied:
    """Apply `ops` (op, path, to_path, is_dir: what coalesce() and pair_untracked() tell) to `catalog`.

    files: path, FILE_COLUMNS and created_at of what is on disk at added and new paths; on_disk: every path there. A rename of a folder that isn't known
    adds the new one, and so does that of an image. Removed images are told at once, but stay until their grace is over (due_removals()).
    """
    ops = materialize(ops, "ops")
    renames = ops.where("op = 'rename'").select("path", "to_path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"))
    catalog, lost_folders = rename_folders(catalog, renames.where("is_dir").select("path", "to_path"))
    image_renames = renames.where("NOT is_dir")
    added_folders = ops.where("op = 'add_folder'").select("path").unionByName(lost_folders.select(F.col("to_path").alias("path")))
    parents = image_renames.select(parent(F.col("to_path")).alias("path")).where("path IS NOT NULL").distinct()
    catalog = _with_folders(catalog, parents)
    ids = catalog.folders.select(F.col("path").alias("above"), F.col("id").alias("folder_id"))
    told = image_renames.select(F.col("path").alias("from"), F.col("to_path").alias("to"), basename(F.col("to_path")).alias("filename"), parent(F.col("to_path")).alias("above")).join(ids, "above").select("from", "to", "filename", "folder_id")
    catalog, renamed = writes.rename_images(catalog, told)
    lost = image_renames.join(renamed.select(F.col("to").alias("to_path")), "to_path", "left_anti").select(F.col("to_path").alias("path"))

    gone = ops.where("op = 'remove'").select("path")
    removed = materialize(writes.image_context(catalog, gone), "removed")

    added = ops.where("op = 'add'").select("path").unionByName(lost).distinct()
    found = materialize(files.select("path", *writes.FILE_COLUMNS, "created_at").join(added, "path", "left_semi"), "found")
    catalog = _with_folders(catalog, added_folders.unionByName(found.select(parent(F.col("path")).alias("path")).where("path IS NOT NULL")).distinct())
    ids = catalog.folders.select(F.col("path").alias("above"), "id").withColumnRenamed("id", "folder_id")
    placed = found.withColumn("above", parent(F.col("path"))).join(ids, "above").select("path", "folder_id", *writes.FILE_COLUMNS, "created_at")
    catalog, saved = writes.upsert_images(catalog, placed, on_disk)

    none = F.array().cast("array<long>")
    here = catalog.images.select("id", F.col("folder_id").alias("now"))
    upserted = saved.join(here, "id").select(F.when(F.col("is_new"), "added").otherwise("updated").alias("op"), F.col("id").alias("image_id"), F.col("now").alias("folder_id"), "old_folder_id", none.alias("tag_ids"))
    moved = renamed.join(here, "id").select(F.lit("updated").alias("op"), F.col("id").alias("image_id"), F.col("now").alias("folder_id"), "old_folder_id", none.alias("tag_ids"))
    away = removed.select(F.lit("removed").alias("op"), F.col("id").alias("image_id"), "folder_id", F.lit(None).cast("long").alias("old_folder_id"), "tag_ids")
    refresh = not added_folders.isEmpty() or not renames.where("is_dir").isEmpty()
    changes = materialize(upserted.unionByName(moved).unionByName(away), "changes")
    return Applied(catalog, changes, gone.withColumn("since", F.current_timestamp()), refresh)


def finish_removals(catalog: Catalog, due: DataFrame, on_disk: DataFrame) -> Catalog:
    """Without the images at `due` (path), and without the folders there that aren't on disk, with all below them."""
    lost = due.join(on_disk.select("path"), "path", "left_anti")
    catalog = writes.delete_images(catalog, due)[0]
    tops = lost.select(F.col("path").alias("head"))
    ways = catalog.folders.select("id", F.explode(ancestors(F.col("path"))).alias("head")).join(tops, "head", "left_semi")
    return writes.drop_folders(catalog, materialize(ways.select("id").distinct(), "lost"))
