"""Ingestion: what is on disk against what the catalog has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.paths import is_under, normalize


def snapshot_diff(disk: DataFrame, images: DataFrame, tolerance_micros: int = 1_000_000) -> DataFrame:
    """(path, state): every file of `disk` (path, size, modified_at) as clean, changed or new.

    Clean files have the size that the catalog has and a time under a second off.
    """
    had = images.select("path", F.col("size").alias("had_size"), F.col("modified_at").alias("had_at"), F.lit(True).alias("had"))
    near = F.abs(F.unix_micros("modified_at") - F.unix_micros("had_at")) < tolerance_micros
    clean = F.coalesce((F.col("size") == F.col("had_size")) & near, F.lit(False))
    state = F.when(F.col("had").isNull(), "new").when(clean, "clean").otherwise("changed")
    return disk.join(had, "path", "left").select("path", state.alias("state"))


def diff_totals(states: DataFrame) -> DataFrame:
    """(total, dirty, clean) files of snapshot_diff()."""
    return states.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") != "clean").alias("dirty"), F.count_if(F.col("state") == "clean").alias("clean"))


def match_moves(files: DataFrame, images: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(path, id, had_folder): files (path, size, created_at) that are images of the same size and creation time whose own path isn't on disk.

    The n-th file of a size and time, by path, takes the n-th such image, by id: each image moves once, as if files came one after another.
    """
    key = ["size", "created_at"]
    lost = images.join(on_disk.select("path"), "path", "left_anti").select(*key, "id", F.col("folder_id").alias("had_folder"))
    lost = lost.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    found = files.select("path", *key).withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("path")))
    return found.join(lost, [*key, "nth"]).select("path", "id", "had_folder")


def orphaned_folders(folders: DataFrame, on_disk: DataFrame, root: str) -> DataFrame:
    """(id, path) of the folders at or below `root` that `on_disk` (path) doesn't have."""
    have = on_disk.select(normalize(F.col("path")).alias("own")).distinct()
    own = folders.where(is_under(F.col("path"), root)).withColumn("own", normalize(F.col("path")))
    return own.join(have, "own", "left_anti").select("id", "path")
