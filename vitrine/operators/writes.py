"""Writes: each takes a catalog and returns one with new tables. One writer at a time; new ids follow the largest."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from vitrine.functions.paths import is_under, replace_prefix
from vitrine.functions.text import equals_nocase
from vitrine.operators.hierarchy import missing_folders, nearest_ancestor, subtree
from vitrine.operators.ingest import match_moves
from vitrine.sources.catalog import SCHEMAS, Catalog
from vitrine.sources.shared import materialize

#: Distance of siblings' order_index after a move.
SPACING = 100
#: What a write to an image may carry from disk.
FILE_COLUMNS = ("filename", "width", "height", "size", "format", "modified_at")
#: Parts that rows are numbered in, so that no task numbers all.
ID_PARTS = 200


def with_ids(rows: DataFrame, table: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """`rows` with ids that go on from the table's largest.

    Rows are numbered inside hash parts, and the parts' counts, ID_PARTS rows, tell where each begins: ids are dense and no sort passes through one task.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(ID_PARTS))
    parted = rows.withColumn("id_part", part)
    before = Window.orderBy("id_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("id_part").count().select("id_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("id_start"))
    last = table.agg(F.max("id")).first()[0] or 0
    nth = F.row_number().over(Window.partitionBy("id_part").orderBy(*order))
    met = parted.withColumn("nth", nth).join(F.broadcast(starts), "id_part")  # ID_PARTS rows
    return met.withColumn(id_col, F.lit(last).cast("long") + F.col("id_start") + F.col("nth")).drop("id_part", "id_start", "nth")


def _fit(rows: DataFrame, table: str) -> DataFrame:
    """`rows` with just the table's columns, absent ones null."""
    names = [c.strip().split() for c in SCHEMAS[table].split(",")]
    return rows.select(*(F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t).alias(n) for n, t in names))


def update(table: DataFrame, where: Column, values: dict[str, Any]) -> DataFrame:
    """`table` with `values` (columns or literals) in the rows that `where` holds for."""
    hit = F.coalesce(where, F.lit(False))
    return table.select(*(F.when(hit, v if isinstance(v := values[c], Column) else F.lit(v)).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns))


# images


def upsert_images(catalog: Catalog, files: DataFrame, on_disk: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog after `files` (path, folder_id, FILE_COLUMNS, created_at), and (path, id, old_folder_id, is_new) of each.

    A known path takes the file's values and keeps created_at, rating, notes, tags and thumbnail. Another file takes over an image of its size and creation
    time whose path isn't in `on_disk` (path): a move, which keeps the id. The rest is new. Of files with one path the last modified counts.
    old_folder_id tells a known image's folder if it changed, and a moved one's always.
    """
    last = Window.partitionBy("path").orderBy(F.desc_nulls_last("modified_at"), F.desc_nulls_last("size"))
    files = materialize(files.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth"), "files")
    images = catalog.images
    own = images.select("path", "id", F.col("folder_id").alias("had_folder"))
    known = files.join(own, "path")
    others = files.join(own, "path", "left_anti")
    moves = materialize(match_moves(others, images, on_disk), "moves")  # path, id, had_folder
    moved = others.join(moves, "path")
    fresh = materialize(with_ids(others.join(moves.select("path"), "path", "left_anti"), images, ["path"]), "fresh")

    news = known.select("id", *(F.col(c).alias(f"new_{c}") for c in ("path", "folder_id", *FILE_COLUMNS)), F.lit(False).alias("is_move"))
    news = news.unionByName(moved.select("id", *(F.col(c).alias(f"new_{c}") for c in ("path", "folder_id", *FILE_COLUMNS)), F.lit(True).alias("is_move")))
    met = images.join(news, "id", "left")
    hit, move = F.col("is_move").isNotNull(), F.coalesce(F.col("is_move"), F.lit(False))
    kept_in_move = ("width", "height", "size")
    columns = [F.when(hit & ~move if c in kept_in_move else hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in news.columns else F.col(c) for c in images.columns]
    born = _fit(fresh.withColumn("rating", F.lit(0)).withColumn("thumbnail_attempts", F.lit(0)).withColumn("added_at", F.current_timestamp()), "images")
    told = known.select("path", "id", F.when(F.col("had_folder") != F.col("folder_id"), F.col("had_folder")).alias("old_folder_id"), F.lit(False).alias("is_new"))
    told = told.unionByName(moved.select("path", "id", F.col("had_folder").alias("old_folder_id"), F.lit(False).alias("is_new")))
    told = told.unionByName(fresh.select("path", "id", F.lit(None).cast("long").alias("old_folder_id"), F.lit(True).alias("is_new")))
    return catalog.put(images=met.select(columns).unionByName(born)), told


def upsert_checked(catalog: Catalog, files: DataFrame, on_disk: DataFrame) -> tuple[Catalog, DataFrame, DataFrame, Observation]:
    """upsert_images() of the rows of `files` that can be written, and the others aside: (catalog, told, quarantine, observation).

    quarantine has each bad row with the first reason that holds: `no path` (null or empty), `no size` (null or below zero), `no folder` (null, or the
    catalog hasn't it), `repeated` (another good row has the path and was modified later, or is larger, or comes after it). One pass tells both sides apart; the observation has
    their numbers, good and bad, once either is computed. No rows, no reasons.
    """
    known = catalog.folders.select(F.col("id").alias("folder_id"), F.lit(True).alias("has_folder"))
    met = files.join(known, "folder_id", "left")
    reason = (
        F.when(F.coalesce(F.col("path"), F.lit("")) == "", "no path")
        .when(F.coalesce(F.col("size"), F.lit(-1)) < 0, "no size")
        .when(F.col("has_folder").isNull(), "no folder")
    )
    judged = met.withColumn("reason", reason).withColumn("own", F.monotonically_increasing_id())
    # bad rows are each by themselves, so that no task gets all null paths
    alike = Window.partitionBy("path", F.when(F.col("reason").isNotNull(), F.col("own"))).orderBy(F.desc_nulls_last("modified_at"), F.desc("size"), F.desc("own"))
    judged = judged.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(alike) > 1, "repeated"))).select(*files.columns, "reason")
    seen = Observation("upsert")
    split = materialize(judged.observe(seen, F.count_if(F.col("reason").isNull()).alias("good"), F.count("reason").alias("bad")), "judged")
    done, told = upsert_images(catalog, split.where("reason IS NULL").drop("reason"), on_disk)
    return done, told, split.where("reason IS NOT NULL"), seen


def set_rating(catalog: Catalog, image_id: int, rating: int) -> Catalog:
    return catalog.put(images=update(catalog.images, F.col("id") == image_id, {"rating": rating}))


def set_notes(catalog: Catalog, image_id: int, notes: str | None) -> Catalog:
    return catalog.put(images=update(catalog.images, F.col("id") == image_id, {"notes": notes}))


def thumbnail_failed(catalog: Catalog, image_id: int, message: str) -> Catalog:
    """One more attempt, and why it failed."""
    return catalog.put(images=update(catalog.images, F.col("id") == image_id, {"thumbnail_attempts": F.coalesce("thumbnail_attempts", F.lit(0)) + 1, "thumbnail_last_error": message}))


def set_thumbnail(catalog: Catalog, image_id: int, path: str | None) -> Catalog:
    """A thumbnail's path, or none; attempts stay."""
    return catalog.put(images=update(catalog.images, F.col("id") == image_id, {"thumbnail_path": path}))


def image_context(catalog: Catalog, paths: DataFrame) -> DataFrame:
    """(path, id, folder_id, tag_ids) of the images at `paths`; no tags are an empty array."""
    hit = catalog.images.join(paths.select("path"), "path", "left_semi").select("path", "id", "folder_id")
    held = catalog.image_tags.join(hit.select(F.col("id").alias("image_id")), "image_id", "left_semi").groupBy("image_id").agg(F.array_sort(F.collect_list("tag_id")).alias("tag_ids"))
    return hit.join(held.withColumnRenamed("image_id", "id"), "id", "left").select("path", "id", "folder_id", F.coalesce("tag_ids", F.array().cast("array<long>")).alias("tag_ids"))


def delete_images(catalog: Catalog, paths: DataFrame) -> tuple[Catalog, DataFrame]:
    """The catalog without the images at `paths` and their tag links, and their context."""
    gone = materialize(image_context(catalog, paths), "gone")
    ids = gone.select("id")
    links = catalog.image_tags.join(ids.withColumnRenamed("id", "image_id"), "image_id", "left_anti").select("image_id", "tag_id")
    return catalog.put(images=catalog.images.join(ids, "id", "left_anti").select(catalog.images.columns), image_tags=links), gone


def rename_images(catalog: Catalog, renames: DataFrame, at: Column | None = None) -> tuple[Catalog, DataFrame]:
    """After `renames` (from, to, filename, folder_id): path, name, folder and modified_at change. Tells (to, id, old_folder_id).

    Images without width, height or format are left as they are, and are not told: the caller adds the new path instead.
    """
    whole = F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("format").isNotNull()
    images = catalog.images
    news = renames.select(F.col("from").alias("path"), F.col("to").alias("new_path"), F.col("filename").alias("new_name"), F.col("folder_id").alias("new_folder"))
    met = materialize(images.join(news, "path", "left").withColumn("hit", F.col("new_path").isNotNull() & whole), "renamed")
    new = {"path": F.col("new_path"), "filename": F.col("new_name"), "folder_id": F.col("new_folder"), "modified_at": F.current_timestamp() if at is None else at}
    told = met.where("hit").select(F.col("new_path").alias("to"), "id", F.when(F.col("folder_id") != F.col("new_folder"), F.col("folder_id")).alias("old_folder_id"))
    return catalog.put(images=met.select(*(F.when(F.col("hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in images.columns))), told


# folders


def ensure_folders(catalog: Catalog, paths: DataFrame, root: str | None = None) -> Catalog:
    """The catalog with every folder on the way to `paths` (path); new ones hang on their parents. With `root`, a scan's, only those at it or below it: what lies above is not a library's."""
    missing = missing_folders(paths, catalog.folders)
    new = materialize(with_ids(missing if root is None else missing.where(is_under(F.col("path"), root)), catalog.folders, ["path"]), "folders")
    either = catalog.folders.select("id", "path").unionByName(new.select("id", "path")).select(F.col("id").alias("above_id"), F.col("path").alias("parent_path"))
    hung = new.join(either, "parent_path", "left").select("id", F.col("above_id").alias("parent_id"), "path", "name", F.lit(False).alias("is_root"))
    return catalog.put(folders=catalog.folders.unionByName(_fit(hung, "folders")))


def upsert_folder(catalog: Catalog, path: str, name: str, parent_id: int | None = None, is_root: bool = False) -> Catalog:
    """A folder at `path`: a new row, or the known one with its new parent. A root stays one; what becomes a root loses its parent."""
    path = path.rstrip("/") or "/"
    folders = catalog.folders
    one = catalog.spark.createDataFrame([(path,)], "path string")
    here = F.col("path") == path
    if folders.where(here).isEmpty():
        here = equals_nocase(F.col("path"), path)
    if not folders.where(here).isEmpty():
        if is_root:
            return catalog.put(folders=update(folders, here, {"is_root": True, "parent_id": None}))
        return catalog.put(folders=update(folders, here & ~F.col("is_root"), {"parent_id": parent_id})) if parent_id is not None else catalog
    new = with_ids(one, folders, ["path"]).withColumns({"name": F.lit(name), "parent_id": F.lit(parent_id).cast("long"), "is_root": F.lit(is_root)})
    return catalog.put(folders=folders.unionByName(_fit(new, "folders")))


def adopt_roots(catalog: Catalog, parent_id: int, parent_path: str) -> Catalog:
    """Roots below `parent_path` become children of `parent_id`."""
    below = F.col("is_root") & (F.col("id") != parent_id) & F.col("path").startswith(parent_path.rstrip("/") + "/")
    return catalog.put(folders=update(catalog.folders, below, {"parent_id": parent_id, "is_root": False}))


def add_location(catalog: Catalog, path: str) -> Catalog:
    """A folder for `path` under the nearest one known above it, or as a root; roots below it become its children."""
    path = path.rstrip("/") or "/"
    above = nearest_ancestor(catalog.spark.createDataFrame([(path,)], "path string"), catalog.folders).first()["parent_id"]
    done = upsert_folder(catalog, path, path.rsplit("/", 1)[-1] or path, above, above is None)
    own = done.folders.where(F.col("path") == path).select("id").first()["id"]
    return adopt_roots(done, own, path)


def rename_folder(catalog: Catalog, old: str, new: str) -> Catalog:
    """Folder `old` at `new`, with the paths of all that is below. If `new` is there already, it takes the children and `old` goes."""
    old, new = old.rstrip("/"), new.rstrip("/")
    ids = {r["path"]: r["id"] for r in catalog.folders.where(F.col("path").isin(old, new)).select("path", "id").collect()}  # two at most
    if old not in ids:
        return catalog
    folders, images = catalog.folders, catalog.images
    if new in ids and new != old:
        images = update(images, F.col("folder_id") == ids[old], {"folder_id": ids[new]})
        folders = update(folders, F.col("parent_id") == ids[old], {"parent_id": ids[new]}).where(F.col("id") != ids[old])
    else:
        folders = update(folders, F.col("id") == ids[old], {"name": new.rsplit("/", 1)[-1]})
    moved = {"path": replace_prefix(F.col("path"), old, new)}
    return catalog.put(folders=update(folders, F.lit(True), moved), images=update(images, F.col("path").startswith(old + "/"), moved))


def delete_folder(catalog: Catalog, folder_id: int) -> Catalog:
    """Without the folder, all below it, their images and the images' tag links."""
    gone = materialize(subtree(catalog.folders, folder_id), "gone")
    return drop_folders(catalog, gone)


def drop_folders(catalog: Catalog, gone: DataFrame) -> Catalog:
    """Without the folders `gone` (id), their images and the images' tag links."""
    lost = catalog.images.join(gone.withColumnRenamed("id", "folder_id"), "folder_id", "left_semi").select(F.col("id").alias("image_id"))
    return catalog.put(
        folders=catalog.folders.join(gone, "id", "left_anti").select(catalog.folders.columns),
        images=catalog.images.join(gone.withColumnRenamed("id", "folder_id"), "folder_id", "left_anti").select(catalog.images.columns),
        image_tags=catalog.image_tags.join(lost, "image_id", "left_anti").select("image_id", "tag_id"),
    )


def folder_thumbnails(catalog: Catalog, folder_id: int) -> DataFrame:
    """(thumbnail_path) of the images in the folder and below."""
    below = subtree(catalog.folders, folder_id).withColumnRenamed("id", "folder_id")
    return catalog.images.where("thumbnail_path IS NOT NULL").join(below, "folder_id", "left_semi").select("thumbnail_path")


# tags


def create_tag(catalog: Catalog, name: str, parent_id: int | None = None, color: str | None = None) -> Catalog:
    """A new tag; a name that is taken is an error."""
    if not catalog.tags.where(F.col("name") == name).isEmpty():
        raise ValueError(f"there is a tag named {name!r}")
    one = catalog.spark.createDataFrame([(name, parent_id, color, 0)], "name string, parent_id long, color string, order_index long")
    return catalog.put(tags=catalog.tags.unionByName(_fit(with_ids(one, catalog.tags, ["name"]), "tags")))


def update_tag(catalog: Catalog, tag_id: int, name: str | None = None, color: str | None = None, parent_id: int | None = None, order_index: int | None = None) -> Catalog:
    """What is given changes; parent 0 is none."""
    given = {"name": name, "color": color, "parent_id": parent_id, "order_index": order_index}
    values = {k: v for k, v in given.items() if v is not None}
    if values.get("parent_id") == 0:
        values["parent_id"] = None
    return catalog.put(tags=update(catalog.tags, F.col("id") == tag_id, values)) if values else catalog


def delete_tag(catalog: Catalog, tag_id: int, with_children: bool = False) -> Catalog:
    """Without the tag and its links; its children lose their parent, or go too."""
    if with_children:
        gone = materialize(subtree(catalog.tags, tag_id), "gone")
    else:
        gone = catalog.spark.createDataFrame([(tag_id,)], "id long")
    tags = catalog.tags.join(gone, "id", "left_anti").select(catalog.tags.columns)
    tags = tags if with_children else update(tags, F.col("parent_id") == tag_id, {"parent_id": None})
    return catalog.put(tags=tags, image_tags=catalog.image_tags.join(gone.withColumnRenamed("id", "tag_id"), "tag_id", "left_anti").select("image_id", "tag_id"))


def assign_tags(catalog: Catalog, image_ids: DataFrame, tag_ids: list[int]) -> Catalog:
    """Every tag on every image (id) of `image_ids`; links that are there stay once."""
    wanted = image_ids.select(F.col("id").alias("image_id")).distinct().select("image_id", F.explode(F.array_distinct(F.array(*map(F.lit, tag_ids)).cast("array<long>"))).alias("tag_id"))
    new = wanted.join(catalog.image_tags, ["image_id", "tag_id"], "left_anti")
    return catalog.put(image_tags=catalog.image_tags.unionByName(new))


def unassign_tag(catalog: Catalog, image_id: int, tag_id: int) -> Catalog:
    return catalog.put(image_tags=catalog.image_tags.where((F.col("image_id") != image_id) | (F.col("tag_id") != tag_id)))


def tag_changes(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(op, tag_id): what to add and what to remove to get from the tags `current` to `wanted`."""
    added = wanted.select("tag_id").distinct().join(current, "tag_id", "left_anti").select(F.lit("add").alias("op"), "tag_id")
    gone = current.select("tag_id").distinct().join(wanted, "tag_id", "left_anti").select(F.lit("remove").alias("op"), "tag_id")
    return added.unionByName(gone)


def move_tag(catalog: Catalog, tag_id: int, target_id: int | None, position: str) -> Catalog:
    """Tag `tag_id` before, after or inside `target_id` (None: the top level); its new siblings are numbered anew, SPACING apart."""
    tags = catalog.tags
    rows = {r["id"]: r for r in tags.where(F.col("id").isin([x for x in (tag_id, target_id) if x is not None])).collect()}  # two at most
    if tag_id not in rows:
        return catalog
    target = rows.get(target_id)
    parent_id = target_id if position == "inside" else target["parent_id"] if target else None
    among = tags.where(F.col("parent_id").eqNullSafe(F.lit(parent_id)) & (F.col("id") != tag_id))
    place = F.lit(3)
    if position != "inside" and target is not None and target_id != tag_id:
        order = F.struct("order_index", "name", "id")
        pivot = F.struct(F.lit(target["order_index"]).cast("long").alias("order_index"), F.lit(target["name"]).alias("name"), F.lit(target_id).cast("long").alias("id"))
        place = F.when(order < pivot, 0).when(order == pivot, 1 if position == "after" else 3).otherwise(4)
    moved = tags.where(F.col("id") == tag_id).withColumn("place", F.lit(2))
    row = among.withColumn("place", place if position != "inside" and target is not None and target_id != tag_id else F.lit(0)).unionByName(moved)
    order_index = (F.row_number().over(Window.orderBy("place", "order_index", "name", "id")) - 1) * SPACING  # one parent's children
    new = row.select("id", order_index.alias("new_order"))
    met = tags.join(new, "id", "left")
    return catalog.put(tags=met.withColumn("order_index", F.coalesce("new_order", "order_index")).withColumn("parent_id", F.when(F.col("id") == tag_id, F.lit(parent_id)).otherwise(F.col("parent_id"))).select(tags.columns))


def free_name(names: DataFrame, base: str = "New Tag") -> str:
    """`base`, or the first `base (n)` that no row of `names` (name) has."""
    taken = names.where(F.col("name").startswith(base)).select(F.when(F.col("name") == base, 0).otherwise(F.regexp_extract("name", r"^.* \((\d{1,9})\)$", 1).try_cast("int")).alias("n")).where("n IS NOT NULL").distinct()
    first = taken.select((F.col("n") + 1).alias("n")).join(taken, "n", "left_anti").agg(F.min("n").alias("n")).first()["n"]
    return base if taken.where("n = 0").isEmpty() else f"{base} ({first})"


# saved searches and settings


def save_search(catalog: Catalog, name: str, query_json: str) -> Catalog:
    one = catalog.spark.createDataFrame([(name, query_json)], "name string, query_json string")
    return catalog.put(smart_folders=catalog.smart_folders.unionByName(_fit(with_ids(one, catalog.smart_folders, ["name"]), "smart_folders")))


def update_search(catalog: Catalog, search_id: int, name: str, query_json: str) -> Catalog:
    return catalog.put(smart_folders=update(catalog.smart_folders, F.col("id") == search_id, {"name": name, "query_json": query_json}))


def delete_search(catalog: Catalog, search_id: int) -> Catalog:
    return catalog.put(smart_folders=catalog.smart_folders.where(F.col("id") != search_id))


def active_search(catalog: Catalog, current_json: str) -> DataFrame:
    """The saved searches whose text is that of the current one, byte by byte."""
    return catalog.smart_folders.where(F.col("query_json") == current_json)


def get_setting(catalog: Catalog, key: str) -> Any:
    """The setting's JSON value; None if there is none or it isn't JSON."""
    import json

    row = catalog.app_settings.where(F.col("key") == key).first()
    try:
        return json.loads(row["value"]) if row and row["value"] is not None else None
    except ValueError:
        return None


def set_setting(catalog: Catalog, key: str, value: Any) -> Catalog:
    import json

    one = catalog.spark.createDataFrame([(key, json.dumps(value))], SCHEMAS["app_settings"])
    return catalog.put(app_settings=catalog.app_settings.where(F.col("key") != key).unionByName(one))
