"""The registered queries over the star schema's catalog, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import media, paths, text
from vitrine.operators import hierarchy, ingest, layout, stats, writes
from vitrine.operators.numbering import numbered
from vitrine.plans import predicate, search
from vitrine.plans.search import LibraryQuery
from vitrine.sources import files, formats
from vitrine.sources.catalog import Catalog, star_catalog
from vitrine.sources.shared import shared_path, table
from vitrine.streaming import changes, retries
from vitrine.streaming.apply import apply_batch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# the catalog of star_catalog(), for DuckDB
TABLES = {
    "folders": """
        SELECT r_regionkey + 1 AS id, CAST(NULL AS BIGINT) AS parent_id, '/' || r_name AS path, r_name AS name, true AS is_root FROM region
        UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, '/' || r_name || '/' || n_name, n_name, false FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, '/' || r_name || '/' || n_name || '/' || c_name, c_name, false
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "images": """
        SELECT o_orderkey AS id, o_custkey + 1000 AS folder_id, '/orders/' || o_custkey || '/Order_' || o_orderkey AS path,
        CASE o_orderstatus WHEN 'F' THEN 'Filled_' WHEN 'O' THEN 'Open_' ELSE 'part.' END || o_orderkey || '.' || substr(o_orderpriority, 1, 1) AS filename,
        CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 4000 + 1 END AS width, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 3000 + 1 END AS height,
        CASE WHEN o_orderkey % 17 > 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS size,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'jpg' WHEN '2-HIGH' THEN 'jpeg' WHEN '3-MEDIUM' THEN 'png' WHEN '4-NOT SPECIFIED' THEN 'JPG' END AS format,
        o_orderkey % 6 AS rating, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority || ' order of ' || o_custkey END AS notes,
        o_orderdate AS created_at, o_orderdate + (o_orderkey % 50) * INTERVAL 1 DAY AS modified_at,
        CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR END AS added_at,
        CASE WHEN o_orderkey % 3 > 0 THEN 'thumb/' || o_orderkey || '.webp' END AS thumbnail_path, o_orderkey % 5 AS thumbnail_attempts
        FROM orders""",
    "tags": "SELECT s_suppkey + 1 AS id, s_name AS name, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey - s_suppkey % 10 + 1 END AS parent_id, s_suppkey % 7 AS order_index FROM supplier",
    "image_tags": "SELECT DISTINCT l_orderkey AS image_id, l_suppkey + 1 AS tag_id FROM lineitem",
    "closure": """
        SELECT id, id AS ancestor, 0 AS distance FROM folders
        UNION ALL SELECT c.id, f.parent_id, c.distance + 1 FROM closure c JOIN folders f ON c.ancestor = f.id WHERE f.parent_id IS NOT NULL""",
}
RFC = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
PLAIN = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def duck(select: str, **more: str) -> str:
    """`select` over the catalog's tables, and those of `more`; only tables that are named are defined."""
    tables = {**TABLES, **more}
    met: list[str] = []
    ordered: list[str] = []

    def need(sql: str) -> None:
        for name in tables:
            if name not in met and re.search(rf"\b{name}\b", sql):
                met.append(name)
                need(tables[name])
                ordered.append(name)

    need(select)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS ({tables[n]})" for n in ordered) + " " if ordered else "") + select


def query(name: str, sql: str | None = None, **more: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = duck(sql, **more)
        return f

    return register


def crit(key: str, operator: str, value: Any) -> predicate.Criterion:
    return predicate.Criterion(key, operator, value)


def both(*items: Any) -> predicate.Group:
    return predicate.Group("and", items)


def either(*items: Any) -> predicate.Group:
    return predicate.Group("or", items)


def matching(name: str, where: str, tree: Any = None, joins: str = "", **params: Any) -> None:
    """Register a search's matches; `where` is the SQL condition over the images, called i."""
    if tree is not None:
        tree = tree if isinstance(tree, predicate.Group) else both(tree)
        params["advanced_query"] = predicate.to_json(tree)

    @query(name, f"SELECT i.id, i.filename, i.format, i.size FROM images i {joins} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return LibraryQuery(**params).matching(star_catalog(spark, sf_dir)).select("id", "filename", "format", "size")


# searches

matching("flt1_quick_search", "i.filename ILIKE '%3-medium ORDER of 1%' OR i.notes ILIKE '%3-medium ORDER of 1%'", search_query="3-medium ORDER of 1")
matching("flt2_folder_direct", "i.folder_id = 1042", folder_id=1042)
matching("flt3_folder_recursive", "i.folder_id IN (SELECT id FROM closure WHERE ancestor = 2)", folder_id=2, recursive=True)
matching("flt4_untagged", "i.id NOT IN (SELECT image_id FROM image_tags)", untagged=True)
matching("flt5_tags_any", "i.id IN (SELECT image_id FROM image_tags WHERE tag_id IN (1, 5, 9))", tag_ids=(1, 5, 9))
matching("flt6_tags_all", "i.id IN (SELECT image_id FROM image_tags WHERE tag_id IN (2, 5) GROUP BY image_id HAVING count(DISTINCT tag_id) = 2)", tag_ids=(2, 5), match_all=True)
matching("flt6_tags_all_repeated", "false", tag_ids=(2, 2), match_all=True)
matching(
    "flt7_nested_or",
    "(i.format = 'jpg' OR i.format = 'jpeg' OR i.rating >= 4) AND (i.id IN (SELECT image_id FROM image_tags WHERE tag_id = 3) OR i.size < 100000)",
    both(either(crit("format", "eq", "jpg"), crit("rating", "gte", 4)), either(crit("tags", "contains", "3"), crit("size", "lt", 100000)), either()),
)
matching("flt8_contains", "lower(i.filename) LIKE '%open#_1%' ESCAPE '#'", crit("filename", "contains", "OPEN_1"))
matching("flt8_contains_short", "false", crit("filename", "contains", "pe"))
matching("flt9_format_contains", "i.format ILIKE '%jp%g%'", crit("format", "contains", "jp%g"))
matching("flt10_not_contains_null", "coalesce(lower(i.notes), '') NOT LIKE '%urgent%'", crit("notes", "not_contains", "urgent"))
matching("flt11_format_not_contains", "i.format NOT ILIKE '%jpe%'", crit("format", "not_contains", "jpe"))
matching("flt12_format_alias", "i.format IN ('jpg', 'jpeg')", crit("format", "equals", "JPEG"))
matching("flt12_format_equals", "i.format ILIKE '%pn%'", crit("format", "eq", "PN"))
matching("flt13_stem_equals", "i.filename = 'PART' OR i.filename ILIKE 'PART.%'", crit("filename", "equals", "PART"))
matching("flt14_notes_equals", "i.notes = '1-URGENT order of 7'", crit("notes", "eq", "1-URGENT order of 7"))
matching("flt15_starts_with", "i.filename ILIKE 'filled_1%'", crit("filename", "starts_with", "filled_1"))
matching("flt16_filename_ends_with", "i.filename ILIKE '%15' OR i.filename ILIKE '%15.%'", crit("filename", "ends_with", "15"))
matching("flt17_notes_ends_with", "i.notes ILIKE '%OF 12'", crit("notes", "ends_with", "OF 12"))
matching("flt18_numbers", "i.size > 400000 OR i.width < 20 OR i.rating = 0 OR (i.height >= 2990 AND i.size <= 0)", either(crit("size", "gt", 400000), crit("width", "lt", 20), crit("rating", "eq", 2.5), both(crit("height", "gte", 2990), crit("size", "lte", "5"))))
matching("flt19_between", "i.size BETWEEN 100000 AND 200000", crit("size", "between", [100000, 200000]))
matching("flt19_between_malformed", "i.rating = 1", crit("rating", "between", [3]))
matching("flt20_number_unknown", "i.rating = 1", crit("rating", "near", 4))
matching("flt21_before_after", f"{RFC.format('i.created_at')} < '1995-03-01' OR {RFC.format('i.created_at')} > '1998-07-20'", either(crit("created_at", "before", "1995-03-01"), crit("created_at", "after", "1998-07-20")))
matching("flt22_on", f"{RFC.format('i.modified_at')} LIKE '1997-05-2%'", crit("modified_at", "on", "1997-05-2"))
matching("flt23_date_between_rfc", f"{RFC.format('i.created_at')} BETWEEN '1996-01-01' AND '1996-02-10 23:59:59'", crit("created_at", "between", ["1996-01-01", "1996-02-10"]))
matching("flt23_date_between_plain", f"{PLAIN.format('i.added_at')} BETWEEN '1996-01-01' AND '1996-02-10 23:59:59'", crit("added_at", "between", ["1996-01-01", "1996-02-10"]))
matching("flt23_date_between_typed", "i.created_at >= '1996-01-01' AND i.created_at < '1996-02-11' OR i.modified_at >= '1998-06-02'", either(crit("created_at", "between", ["1996-01-01", "1996-02-10"]), crit("modified_at", "after", "1998-06-01")), typed_times=True)
matching("flt24_date_unknown", "i.rating = 5", either(crit("added_at", "near", "1996-01-01"), crit("rating", "eq", 5)))
matching("flt25_tags_contains", "i.id IN (SELECT image_id FROM image_tags WHERE tag_id = 7)", crit("tags", "contains_any", "7"))
matching("flt26_tags_not_contains", "i.id NOT IN (SELECT image_id FROM image_tags WHERE tag_id = 7)", crit("tags", "not_contains", 7))
matching("flt30_no_ops", "i.rating = 2", both(crit("tags", "near", 1), crit("tags", "contains", "x"), crit("folder", "near", 1), crit("colour", "is", 1), crit("format", "neq", "jpg"), crit("rating", "eq", 2)))
matching("flt28_folder_is", "i.folder_id = 1005", crit("folder", "is", 1005))
matching("flt29_folder_in", "i.rating = 3 OR i.folder_id IN (SELECT id FROM closure WHERE ancestor = 103)", either(crit("folder", "in", 103), crit("rating", "eq", 3)))
matching("flt31_bad_json", "i.folder_id = 1011", folder_id=1011, advanced_query='{"id": "1", "items": []}')
matching(
    "jn1_combined",
    "i.folder_id IN (SELECT id FROM closure WHERE ancestor = 3) AND i.notes ILIKE '%order%' AND i.size > 150000 AND i.id IN (SELECT image_id FROM image_tags WHERE tag_id IN (1, 2, 3, 4))",
    crit("size", "gt", 150000),
    folder_id=3,
    recursive=True,
    search_query="order",
    tag_ids=(1, 2, 3, 4),
)


def page(name: str, order: str, where: str = "true", **params: Any) -> None:
    """Register a page of a search, with each row's place in it."""
    limit, offset = params["limit"], params.get("offset", 0)
    limited = f"{f'LIMIT {limit}' if limit >= 0 else ''} OFFSET {max(offset, 0)}"

    @query(name, f"SELECT i.id, i.filename, i.size, i.format, row_number() OVER (ORDER BY {order}) AS place FROM images i JOIN (SELECT id FROM images i WHERE {where} ORDER BY {order} {limited}) p ON i.id = p.id")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = LibraryQuery(**params)
        found = asked.to_df(star_catalog(spark, sf_dir))
        return found.withColumn("place", F.row_number().over(Window.orderBy(*asked.order()))).select("id", "filename", "size", "format", "place")


NAME = "lower(i.filename)"
page("srt1_default_order", "i.id DESC", sort_by="path", limit=100)
page("srt2_bad_direction", f"i.size DESC NULLS LAST, {NAME}, i.id", sort_by="size", sort_order="down", limit=100)
page("srt3_nulls_last_asc", f"i.size ASC NULLS LAST, {NAME}, i.id", "i.rating = 3", sort_by="size", sort_order="asc", limit=10_000_000, advanced_query=predicate.to_json(both(crit("rating", "eq", 3))))
page("srt3_nulls_last_desc", f"i.added_at DESC NULLS LAST, {NAME}, i.id", "i.rating = 4", sort_by="added_at", sort_order="desc", limit=10_000_000, advanced_query=predicate.to_json(both(crit("rating", "eq", 4))))
page("srt4_nocase", f"lower(i.format) ASC NULLS LAST, {NAME}, i.id", sort_by="format", sort_order="asc", limit=500, offset=40)
page("srt5_name", f"{NAME} DESC, i.id", sort_by="filename", sort_order="desc", limit=300)
page("srt6_page", f"i.modified_at DESC NULLS LAST, {NAME}, i.id", sort_by="modified_at", sort_order="desc", limit=100, offset=200)
page("srt6_negative", f"i.rating ASC NULLS LAST, {NAME}, i.id", "i.folder_id = 1020", sort_by="rating", sort_order="asc", limit=-1, offset=-5, folder_id=1020)


@query("prj1_result_columns", "SELECT id, path, filename, width, height, size, thumbnail_path, format, rating, notes, created_at, modified_at, added_at FROM images WHERE folder_id IN (SELECT id FROM closure WHERE ancestor = 104) AND id IN (SELECT image_id FROM image_tags)")
def prj1_result_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return LibraryQuery(folder_id=104, recursive=True).to_df(c).join(c.image_tags.select(F.col("image_id").alias("id")), "id", "left_semi")


@query("ag7_count", "SELECT count(*) AS count FROM images WHERE rating >= 3 AND id IN (SELECT image_id FROM image_tags WHERE tag_id IN (1, 2))")
def ag7_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LibraryQuery(tag_ids=(1, 2), advanced_query=predicate.to_json(both(crit("rating", "gte", 3)))).count(star_catalog(spark, sf_dir))


@query("flt32_needs_thumbnail", "SELECT id, path FROM images WHERE thumbnail_path IS NULL AND thumbnail_attempts < 3")
def flt32_needs_thumbnail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.needs_thumbnail(star_catalog(spark, sf_dir).images, limit=2_000_000_000)


@query("flt33_needs_thumbnail_of", "SELECT id, path FROM images WHERE thumbnail_path IS NULL AND thumbnail_attempts < 3 AND id IN (3, 6, 9, 12, 15)")
def flt33_needs_thumbnail_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.needs_thumbnail(star_catalog(spark, sf_dir).images, limit=100, ids=[3, 6, 9, 12, 15])


@query("flt34_roots", "SELECT id, path FROM folders WHERE is_root OR parent_id IS NULL")
def flt34_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.roots(star_catalog(spark, sf_dir).folders)


@query("flt35_under_path", "SELECT id, path FROM folders WHERE path = '/ASIA' OR starts_with(path, '/ASIA/')")
def flt35_under_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.under_path(star_catalog(spark, sf_dir).folders, "/ASIA/")


@query("flt36_nocase_lookup", "SELECT id, path FROM folders WHERE lower(path) = '/europe'")
def flt36_nocase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_folder(star_catalog(spark, sf_dir).folders, "/Europe").select("id", "path")


@query("flt37_point_lookup", "SELECT id, size, created_at FROM images WHERE path IN ('/orders/1/Order_5', '/orders/330/Order_2', '/orders/769/Order_1')")
def flt37_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("/orders/1/Order_5", "/orders/330/Order_2", "/orders/769/Order_1")
    return star_catalog(spark, sf_dir).images.where(F.col("path").isin(*wanted)).select("id", "size", "created_at")


POSITIONS = "SELECT p_partkey AS id, (p_partkey % 5) * 200.0 AS x, floor(p_partkey / 5) * 210.5 AS y, 190.0 AS width, p_size * 13.0 + 50 AS height FROM part"


@query(
    "flt38_visible",
    "SELECT view_id, p.*, row_number() OVER (PARTITION BY view_id ORDER BY y, x, id) AS place FROM positions p JOIN looks v ON y + height > greatest(0, first) AND y < last",
    positions=POSITIONS.replace("200.0", "CAST(200 AS DOUBLE)").replace("210.5", "CAST(210.5 AS DOUBLE)").replace("190.0", "CAST(190 AS DOUBLE)").replace("13.0", "CAST(13 AS DOUBLE)"),
    looks="SELECT n_nationkey AS view_id, n_nationkey * 1500.0 - 300 AS first, n_nationkey * 1500.0 + 900 + 300 AS last FROM nation",
)
def flt38_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST((p_partkey % 5) * 200 AS DOUBLE) AS x", "CAST(floor(p_partkey / 5) * 210.5 AS DOUBLE) AS y", "CAST(190 AS DOUBLE) AS width", "CAST(p_size * 13 + 50 AS DOUBLE) AS height")
    views = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS view_id", "CAST(n_nationkey * 1500 AS DOUBLE) AS top", "CAST(900 AS DOUBLE) AS height")
    return layout.visible(spots, views, buffer=300.0)


@query("flt39_autocomplete", "SELECT name FROM tags WHERE lower(name) LIKE '%r#0000000%' AND name <> 'Supplier#000000003'")
def flt39_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = star_catalog(spark, sf_dir).tags
    return search.suggestions(tags.select("name"), "R#0000000", tags.where("id = 4"))


@query("flt40_is_below", "SELECT id, distance FROM closure WHERE ancestor = 2 AND distance > 0")
def flt40_is_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.closure(star_catalog(spark, sf_dir).folders).where("ancestor = 2 AND distance > 0").select("id", "distance")


@query("flt41_active_search", "SELECT s_suppkey + 1 AS id, s_name AS name FROM supplier WHERE s_suppkey % 10 = 4")
def flt41_active_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 1 AS id", "s_name AS name", "'{\"rating\":' || s_suppkey % 10 || '}' AS query_json")
    return writes.active_search(Catalog(spark, {"smart_folders": saved}), '{"rating":4}').select("id", "name")


# scans, formats


@query("src7_folders", "SELECT id, parent_id, path, name, is_root, row_number() OVER (ORDER BY path) - 1 AS place FROM folders")
def src7_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(star_catalog(spark, sf_dir).folders, ["path"])


@query("src8_tags", "SELECT id, name, order_index, row_number() OVER (ORDER BY order_index, name) - 1 AS place FROM tags")
def src8_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(star_catalog(spark, sf_dir).tags.select("id", "name", "order_index"), ["order_index", "name"])


@query("src11_prefix_snapshot", "SELECT path, size, modified_at FROM images WHERE path = '/orders/77' OR starts_with(path, '/orders/77/')")
def src11_prefix_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_catalog(spark, sf_dir).images.where(paths.is_under(F.col("path"), "/orders/77")).select("path", "size", "modified_at")


@query("src3_supported", f"SELECT id FROM images WHERE lower(format) IN ({', '.join(repr(e) for r in formats.registry_rows() for e in r[2])})")
def src3_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = star_catalog(spark, sf_dir).images.select("id", F.concat(F.lit("/a/b."), F.coalesce("format", F.lit(""))).alias("path"))
    return formats.supported(named, formats.registry(spark)).select("id")


VALUES = ", ".join("({}, {}, {}, {}, {})".format(r[0], *(repr(x) if "'" not in x else "'" + x.replace("'", "''") + "'" for x in (r[1], " ".join(r[2]), r[4], r[7]))) for r in formats.registry_rows())
REGISTRY = f"SELECT * FROM (VALUES {VALUES}) v(place, name, extensions, category, playback)"


@query(
    "src5_registry",
    """SELECT place, name, len(string_split(extensions, ' ')) AS n_extensions, category, playback, count(i.id) AS n_images FROM known_formats
        LEFT JOIN images i ON list_contains(string_split(extensions, ' '), lower(i.format)) GROUP BY ALL""",
    known_formats=REGISTRY,
)
def src5_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every format, with how many images have one of its extensions."""
    held = star_catalog(spark, sf_dir).images.groupBy(F.lower("format").alias("extension")).count()
    ways = formats.registry(spark).select("*", F.explode("extensions").alias("extension")).join(held, "extension", "left")
    return ways.groupBy("place", "name", F.size("extensions").alias("n_extensions"), "category", "playback").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_images"))


@query("src6_extension_map", "SELECT extension, arg_max(name, place) AS name, count(DISTINCT i.id) AS n_images FROM (SELECT unnest(string_split(extensions, ' ')) AS extension, name, place FROM known_formats) LEFT JOIN images i ON lower(i.format) = extension GROUP BY extension", known_formats=REGISTRY)
def src6_extension_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each extension stands for, with how many images have it."""
    held = star_catalog(spark, sf_dir).images.groupBy(F.lower("format").alias("extension")).agg(F.count(F.lit(1)).alias("n_images"))
    return formats.by_extension(formats.registry(spark), last_wins=True).join(held, "extension", "left").select("extension", "name", F.coalesce("n_images", F.lit(0)).alias("n_images"))


@query(
    "src4_detect",
    "SELECT id, e.name AS format_name, e.category, e.playback FROM images LEFT JOIN (SELECT extension, arg_min(name, place) AS name, arg_min(category, place) AS category, arg_min(playback, place) AS playback FROM (SELECT unnest(string_split(extensions, ' ')) AS extension, * EXCLUDE (extensions) FROM known_formats) GROUP BY extension) e ON lower(format) = extension",
    known_formats=REGISTRY,
)
def src4_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = star_catalog(spark, sf_dir).images.select("id", F.concat(F.lit("/a/b."), F.coalesce("format", F.lit(""))).alias("path"))
    return formats.detect(named, formats.registry(spark), content_col=None).select("id", "format_name", "category", "playback")


# Joins and statistics. From here on, an order's priority (an image's format) and its status (how its filename begins) tell what has changed: files on disk,
# events, changes to apply. Whole tables go in.


@query("jn2_tags_of_images", "SELECT image_id, t.id, name, row_number() OVER (PARTITION BY image_id ORDER BY order_index, name) AS place FROM tags t JOIN image_tags ON t.id = tag_id")
def jn2_tags_of_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    held = c.image_tags.join(c.tags.withColumnRenamed("id", "tag_id"), "tag_id")
    return held.select("image_id", F.col("tag_id").alias("id"), "name", F.row_number().over(Window.partitionBy("image_id").orderBy("order_index", "name")).alias("place"))


DISK = """SELECT path, CASE WHEN format = 'jpg' THEN coalesce(size, 0) + 1 ELSE coalesce(size, 0) END AS size,
    modified_at + INTERVAL {half} * (CASE WHEN format IN ('jpeg', 'png') THEN 1 ELSE 0 END) + INTERVAL {one} * (CASE WHEN format IN ('png', 'JPG') THEN 1 ELSE 0 END) AS modified_at FROM images WHERE NOT starts_with(filename, 'part.')
    UNION ALL SELECT path || '_new', coalesce(size, 0), modified_at FROM images WHERE starts_with(filename, 'part.')"""


def _is(*formats: str) -> Column:
    return F.coalesce(F.col("format").isin(*formats), F.lit(False))


PARTIAL = "filename LIKE 'part.%'"


def _disk(c: Catalog) -> DataFrame:
    i = c.images.withColumn("size", F.coalesce("size", F.lit(0)))
    at = F.timestamp_micros(F.unix_micros(F.col("modified_at").cast("timestamp")) + F.when(_is("jpeg", "png"), 500_000).otherwise(0) + F.when(_is("png", "JPG"), 1_000_000).otherwise(0))
    had = i.where(f"NOT {PARTIAL}").select("path", (F.col("size") + _is("jpg").cast("int")).alias("size"), at.alias("modified_at"))
    return had.unionByName(i.where(PARTIAL).select(F.concat("path", F.lit("_new")).alias("path"), "size", F.col("modified_at").cast("timestamp").alias("modified_at")))


JN7 = """SELECT d.path, CASE WHEN i.path IS NULL THEN 'new' WHEN coalesce(d.size = i.size AND abs(epoch_us(d.modified_at) - epoch_us(i.modified_at)) < 1000000, false) THEN 'clean' ELSE 'changed' END AS state
    FROM disk d LEFT JOIN images i ON d.path = i.path"""


def _cat(spark: SparkSession, sf_dir: str) -> Catalog:
    c = star_catalog(spark, sf_dir)
    return c.put(images=c.images.withColumns({n: F.col(n).cast("timestamp") for n in ("created_at", "modified_at", "added_at")}))


@query("jn7_snapshot_diff", JN7, disk=DISK.format(half="500 MILLISECOND", one="1 SECOND"))
def jn7_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _cat(spark, sf_dir)
    return ingest.snapshot_diff(_disk(c), c.images)


@query("ag9_scan_totals", f"SELECT count(*) AS total, count(*) FILTER (state <> 'clean') AS dirty, count(*) FILTER (state = 'clean') AS clean FROM ({JN7})", disk=DISK.format(half="500 MILLISECOND", one="1 SECOND"))
def ag9_scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.diff_totals(jn7_snapshot_diff(spark, sf_dir))


FOUND = "SELECT '/moved/' || id AS path, size, created_at FROM images WHERE starts_with(filename, 'part.') OR format = 'jpeg'"
HERE = "SELECT path FROM images WHERE NOT starts_with(filename, 'part.')"
MOVES = """SELECT f.path, l.id, l.folder_id AS had_folder FROM (SELECT *, row_number() OVER (PARTITION BY size, created_at ORDER BY path) AS nth FROM found_files) f
    JOIN (SELECT *, row_number() OVER (PARTITION BY size, created_at ORDER BY id) AS nth FROM images WHERE path NOT IN (SELECT path FROM still_there)) l
    ON f.size = l.size AND f.created_at = l.created_at AND f.nth = l.nth"""


def _found(c: Catalog) -> DataFrame:
    return c.images.where(f"{PARTIAL} OR format = 'jpeg'").select(F.concat(F.lit("/moved/"), "id").alias("path"), "size", "created_at")


@query("jn8_move_detect", MOVES, found_files=FOUND, still_there=HERE)
def jn8_move_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return ingest.match_moves(_found(c), c.images, c.images.where(f"NOT {PARTIAL}"))


@query("jn10_batch_tag", "SELECT DISTINCT image_id, tag_id FROM (SELECT id AS image_id, t AS tag_id FROM images, (VALUES (1), (2), (3)) v(t) WHERE rating = 5 UNION ALL SELECT image_id, tag_id FROM image_tags)")
def jn10_batch_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return writes.assign_tags(c, c.images.where("rating = 5"), [1, 2, 3, 3]).image_tags


@query("jn11_tag_forest", "SELECT t.id, p.id AS parent_id, t.name, coalesce(n, 0) AS count FROM tags t LEFT JOIN tags p ON t.parent_id = p.id LEFT JOIN (SELECT tag_id, count(*) AS n FROM image_tags GROUP BY tag_id) c ON t.id = tag_id")
def jn11_tag_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return hierarchy.forest_of(c.tags, stats.tag_counts(c).withColumnRenamed("tag_id", "id"))


TOTALS = "SELECT (SELECT count(*) FROM images) AS total_images, (SELECT count(*) FROM images WHERE id NOT IN (SELECT image_id FROM image_tags)) AS untagged_images"


@query("ag1_totals", TOTALS)
def ag1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(star_catalog(spark, sf_dir))


@query("ag3_tag_counts", "SELECT tag_id, count(*) AS count FROM image_tags GROUP BY tag_id")
def ag3_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.tag_counts(star_catalog(spark, sf_dir))


@query("ag4_folder_direct", "SELECT folder_id, count(*) AS count FROM images GROUP BY folder_id")
def ag4_folder_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.folder_counts(star_catalog(spark, sf_dir))


RECURSIVE = "SELECT ancestor AS folder_id, count(i.id) AS count FROM closure c LEFT JOIN images i ON i.folder_id = c.id GROUP BY ancestor"


@query("ag5_folder_recursive", RECURSIVE)
def ag5_folder_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.folder_counts_recursive(star_catalog(spark, sf_dir))


COUNTERS = f"""SELECT 'total' AS kind, CAST(NULL AS BIGINT) AS key, total_images AS count FROM ({TOTALS}) UNION ALL SELECT 'untagged', NULL, untagged_images FROM ({TOTALS})
    UNION ALL SELECT 'tag', tag_id, count(*) FROM image_tags GROUP BY tag_id UNION ALL SELECT 'folder', folder_id, count(*) FROM images GROUP BY folder_id
    UNION ALL SELECT 'folder_recursive', folder_id, count FROM ({RECURSIVE})"""


@query("ag6_counters", COUNTERS)
def ag6_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counters(star_catalog(spark, sf_dir))


@query("ag10_cache_usage", "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM images")
def ag10_cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.cache_usage(star_catalog(spark, sf_dir).images)


# removed: jpg; added: as many as there are jpeg, in folder 1001; updated: png go to folder 1002
AFTER = """SELECT kind, key, CAST(CASE WHEN kind IN ('total', 'untagged') THEN n - gone ELSE greatest(n - gone, 0) END + born AS BIGINT) AS count FROM (
    SELECT kind, key, sum(n) AS n, sum(gone) AS gone, sum(born) AS born FROM (
    SELECT kind, key, count AS n, 0 AS gone, 0 AS born FROM before
    UNION ALL SELECT 'total', NULL, 0, 1, 0 FROM images WHERE format = 'jpg' UNION ALL SELECT 'total', NULL, 0, 0, 1 FROM images WHERE format = 'jpeg'
    UNION ALL SELECT 'untagged', NULL, 0, 1, 0 FROM images WHERE format = 'jpg' AND id NOT IN (SELECT image_id FROM image_tags) UNION ALL SELECT 'untagged', NULL, 0, 0, 1 FROM images WHERE format = 'jpeg'
    UNION ALL SELECT 'tag', tag_id, 0, 1, 0 FROM image_tags WHERE image_id IN (SELECT id FROM images WHERE format = 'jpg')
    UNION ALL SELECT 'folder', folder_id, 0, gone, born FROM steps
    UNION ALL SELECT 'folder_recursive', ancestor, 0, gone, born FROM steps JOIN closure c ON c.id = folder_id) GROUP BY kind, key)"""
STEPS = """SELECT folder_id, 1 AS gone, 0 AS born FROM images WHERE format = 'jpg' UNION ALL SELECT 1001, 0, 1 FROM images WHERE format = 'jpeg'
    UNION ALL SELECT folder_id, 1, 0 FROM images WHERE format = 'png' AND folder_id <> 1002 UNION ALL SELECT 1002, 0, 1 FROM images WHERE format = 'png' AND folder_id <> 1002"""


def _changes(c: Catalog) -> DataFrame:
    op = F.when(_is("jpg"), "removed").when(_is("jpeg"), "added").otherwise("updated")
    rows = c.images.where("format IN ('jpg', 'jpeg', 'png')").select(op.alias("op"), F.col("id").alias("image_id"), F.when(op == "removed", F.col("folder_id")).when(op == "added", 1001).otherwise(1002).alias("folder_id"), F.when(op == "updated", F.col("folder_id")).alias("old_folder_id"))
    held = c.image_tags.join(rows.where("op = 'removed'").select("image_id"), "image_id", "left_semi").groupBy("image_id").agg(F.collect_list("tag_id").alias("tag_ids"))
    return rows.join(held, "image_id", "left").select("op", "image_id", "folder_id", "old_folder_id", "tag_ids")


@query("ag11_incremental", AFTER, before=COUNTERS, steps=STEPS)
def ag11_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return stats.apply_deltas(stats.counters(c), stats.counter_deltas(_changes(c), c.folders))


@query("ag12_waveform")
def ag12_waveform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", media.waveform(F.col("embedding"), points=16).alias("peaks"))


@query("ag13_masonry")
def ag13_masonry(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = star_catalog(spark, sf_dir).images.select("folder_id", "id", media.aspect_ratio(F.col("width"), F.col("height")).alias("aspect"))
    return layout.masonry_layout(images, ["folder_id"], [], container=1200.0, item=220.0, gap=16.0)


@query(
    "ag13_justified",
    """SELECT folder_id, id, ahead * scale / 1000000::DOUBLE + (nth - 1) * 16::DOUBLE AS x, coalesce(above, 0)::BIGINT / 1000000::DOUBLE AS y, wide * scale / 1000000::DOUBLE AS width, 220::DOUBLE * scale AS height
        FROM (SELECT *, row_number() OVER w AS nth, coalesce(sum(wide) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM walk WINDOW w AS (PARTITION BY folder_id, line ORDER BY k)) JOIN tops USING (folder_id, line)""",
    listed="SELECT folder_id, id, CAST(round(220::DOUBLE * coalesce(width / height::DOUBLE, 1) * 1000000) AS BIGINT) AS wide, row_number() OVER (PARTITION BY folder_id ORDER BY id) AS k FROM images",
    walk="""SELECT folder_id, id, wide, k, 1 AS line, wide AS used FROM listed WHERE k = 1 UNION ALL SELECT l.folder_id, l.id, l.wide, l.k, w.line + (used + l.wide + 16000000 > 1200000000)::INT,
        CASE WHEN used + l.wide + 16000000 > 1200000000 THEN l.wide ELSE used + l.wide + 16000000 END FROM walk w JOIN listed l ON w.folder_id = l.folder_id AND l.k = w.k + 1""",
    fills="SELECT folder_id, line, count(*) AS n, sum(wide)::BIGINT AS total, line = max(line) OVER (PARTITION BY folder_id) AS is_last FROM walk GROUP BY folder_id, line",
    scales="SELECT *, CASE WHEN is_last AND (1200::DOUBLE - (n - 1) * 16::DOUBLE) * 1000000 / total > 1.2::DOUBLE THEN 1::DOUBLE ELSE (1200::DOUBLE - (n - 1) * 16::DOUBLE) * 1000000 / total END AS scale FROM fills",
    tops="SELECT folder_id, line, scale, sum(CAST(round((220::DOUBLE * scale + 16::DOUBLE) * 1000000) AS BIGINT)) OVER (PARTITION BY folder_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM scales",
)
def ag13_justified(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = star_catalog(spark, sf_dir).images.select("folder_id", "id", media.aspect_ratio(F.col("width"), F.col("height")).alias("aspect"))
    return layout.justified_layout(images, ["folder_id"], [], container=1200.0, row_height=220.0, gap=16.0)


@query("win_grid_layout", "SELECT id, (place % 5) * 243.2 AS x, floor(place / 5) * 243.2 AS y FROM (SELECT id, CAST(row_number() OVER (ORDER BY created_at, id) - 1 AS DOUBLE) AS place FROM images)".replace("243.2", "CAST(243.2 AS DOUBLE)"))
def win_grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.grid_layout(star_catalog(spark, sf_dir).images, ["created_at"], container=1200.0, item=220.0, gap=16.0).select("id", "x", "y")


@query("ag14_segments", "SELECT p_partkey AS id, i AS index, i * CAST(10 AS DOUBLE) AS start, least(p_retailprice - i * CAST(10 AS DOUBLE), CAST(10 AS DOUBLE)) AS length FROM part, unnest(range(CAST(ceil(p_retailprice / 10) AS INT))) u(i)")
def ag14_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.inline(media.segments(F.col("p_retailprice"))))


# sets, orders, trees


@query("srt9_parents_first", "SELECT path, row_number() OVER (ORDER BY length(path), path) - 1 AS place FROM folders")
def srt9_parents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(star_catalog(spark, sf_dir).folders.select("path", F.length("path").alias("n")), ["n", "path"]).drop("n")


@query("srt10_siblings", "SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY order_index, name) AS place FROM tags")
def srt10_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_catalog(spark, sf_dir).tags.select("id", "parent_id", F.row_number().over(Window.partitionBy("parent_id").orderBy("order_index", "name")).alias("place"))


@query(
    "srt11_depth_first",
    "SELECT id, depth, row_number() OVER (ORDER BY way) - 1 AS place FROM ways",
    sibs="SELECT id, parent_id, lpad(CAST(row_number() OVER (PARTITION BY parent_id ORDER BY order_index, name, id) AS VARCHAR), 12, '0') AS own FROM tags",
    ways="SELECT id, 0 AS depth, own AS way FROM sibs WHERE parent_id IS NULL UNION ALL SELECT s.id, w.depth + 1, w.way || '/' || s.own FROM ways w JOIN sibs s ON s.parent_id = w.id",
)
def srt11_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.tree_rows(star_catalog(spark, sf_dir).tags, ["order_index", "name"])


@query("set3_prune", "SELECT id, path FROM folders WHERE (path = '/ASIA' OR starts_with(path, '/ASIA/')) AND name >= 'J'")
def set3_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return ingest.orphaned_folders(c.folders, c.folders.where("name < 'J'").select(F.concat("path", F.lit("/")).alias("path")), "/ASIA")


@query("set4_tag_changes", "SELECT CASE WHEN w THEN 'add' ELSE 'remove' END AS op, tag_id FROM (SELECT tag_id, bool_or(image_id = 42) AS w, bool_or(image_id = 7) AS h FROM image_tags WHERE image_id IN (7, 42) GROUP BY tag_id) WHERE w <> h")
def set4_tag_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = star_catalog(spark, sf_dir).image_tags
    return writes.tag_changes(links.where("image_id = 7"), links.where("image_id = 42"))


# writes


@query(
    "wr1_upsert",
    f"""SELECT f.path, CASE WHEN k.id IS NOT NULL THEN k.id ELSE m.id END AS id, CASE WHEN k.id IS NOT NULL THEN nullif(k.folder_id, 1001) ELSE m.had_folder END AS old_folder_id,
        k.id IS NULL AND m.id IS NULL AS is_new FROM all_files f LEFT JOIN images k ON f.path = k.path LEFT JOIN ({MOVES}) m ON f.path = m.path""",
    found_files=FOUND,
    still_there=HERE,
    all_files="SELECT path FROM found_files UNION ALL SELECT path FROM images WHERE format = 'jpg' AND NOT starts_with(filename, 'part.')",
)
def wr1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    new = c.images.where(f"{PARTIAL} OR format = 'jpeg'").withColumn("path", F.concat(F.lit("/moved/"), "id"))
    given = new.unionByName(c.images.where(f"format = 'jpg' AND NOT {PARTIAL}")).withColumn("folder_id", F.lit(1001).cast("long"))
    told = writes.upsert_images(c, given.select("path", "folder_id", *writes.FILE_COLUMNS, "created_at"), c.images.where(f"NOT {PARTIAL}"))[1]
    return told.withColumn("id", F.when(~F.col("is_new"), F.col("id"))).select("path", "id", "old_folder_id", "is_new")


@query("wr2_rating_notes", "SELECT id, CASE WHEN id = 5 THEN 1 ELSE rating END AS rating, CASE WHEN id = 6 THEN 'seen' ELSE notes END AS notes FROM images")
def wr2_rating_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.set_notes(writes.set_rating(star_catalog(spark, sf_dir), 5, 1), 6, "seen").images.select("id", "rating", "notes")


@query("wr3_thumbnails", "SELECT id, CASE id WHEN 7 THEN 't' WHEN 8 THEN NULL ELSE thumbnail_path END AS thumbnail_path, CASE WHEN id = 9 THEN thumbnail_attempts + 1 ELSE thumbnail_attempts END AS thumbnail_attempts, CASE WHEN id = 9 THEN 'bad' END AS thumbnail_last_error FROM images")
def wr3_thumbnails(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = writes.set_thumbnail(writes.set_thumbnail(star_catalog(spark, sf_dir), 7, "t"), 8, None)
    return writes.thumbnail_failed(c, 9, "bad").images.select("id", "thumbnail_path", "thumbnail_attempts", "thumbnail_last_error")


@query("wr4_delete_context", "SELECT path, i.id, folder_id, coalesce(string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY tag_id), '') AS tag_ids FROM images i LEFT JOIN image_tags ON i.id = image_id WHERE i.format = 'JPG' GROUP BY path, i.id, folder_id")
def wr4_delete_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    gone = writes.delete_images(c, c.images.where("format = 'JPG'").select("path"))[1]
    return gone.withColumn("tag_ids", F.array_join("tag_ids", ","))


@query("wr5_rename_images", "SELECT path || '.moved' AS to, id, nullif(folder_id, 1002) AS old_folder_id FROM images WHERE format = 'png' AND width IS NOT NULL AND height IS NOT NULL AND format IS NOT NULL")
def wr5_rename_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    renames = c.images.where("format = 'png'").select(F.col("path").alias("from"), F.concat("path", F.lit(".moved")).alias("to"), F.lit("n").alias("filename"), F.lit(1002).cast("long").alias("folder_id"))
    return writes.rename_images(c, renames)[1]


@query("wr7_ensure_folders", "SELECT DISTINCT '/orders/' || o_custkey AS path, CAST(o_custkey AS VARCHAR) AS name, '/orders' AS parent FROM orders UNION ALL SELECT '/orders', 'orders', NULL")
def wr7_ensure_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    done = writes.ensure_folders(c, c.images.select(paths.parent(F.col("path")).alias("path")).distinct()).folders
    above = done.select(F.col("id").alias("parent_id"), F.col("path").alias("parent"))
    return done.where("path LIKE '/orders%'").join(above, "parent_id", "left").select("path", "name", "parent")


@query("wr9_rename_folder", "SELECT id, name, CASE WHEN path = '/ASIA' OR starts_with(path, '/ASIA/') THEN '/Orient' || substr(path, 6) ELSE path END AS path FROM (SELECT id, path, CASE WHEN path = '/ASIA' THEN 'Orient' ELSE name END AS name FROM folders)")
def wr9_rename_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.rename_folder(star_catalog(spark, sf_dir), "/ASIA", "/Orient").folders.select("id", "name", "path")


@query("wr10_adopt", "SELECT id, CASE WHEN is_root AND id > 1 THEN 1 ELSE parent_id END AS parent_id, id = 1 AS is_root FROM folders")
def wr10_adopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.adopt_roots(star_catalog(spark, sf_dir), 1, "").folders.select("id", "parent_id", "is_root")


@query("wr11_nearest_ancestor", "SELECT f.path || '/deep/er' AS path, f.id AS parent_id FROM folders f UNION ALL SELECT '/nowhere/at/all', NULL")
def wr11_nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = star_catalog(spark, sf_dir).folders
    asked = folders.select(F.concat("path", F.lit("/deep/er")).alias("path")).unionByName(spark.createDataFrame([("/nowhere/at/all",)], "path string"))
    return hierarchy.nearest_ancestor(asked, folders)


GONE = "SELECT id FROM closure WHERE ancestor = 3"


@query("wr12_cascade_delete", f"SELECT 'folders' AS name, count(*) AS n FROM folders WHERE id NOT IN ({GONE}) UNION ALL SELECT 'images', count(*) FROM images WHERE folder_id NOT IN ({GONE}) UNION ALL SELECT 'image_tags', count(*) FROM image_tags JOIN images i ON i.id = image_id WHERE folder_id NOT IN ({GONE})")
def wr12_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = writes.delete_folder(star_catalog(spark, sf_dir), 3)
    sizes = [getattr(c, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n")) for t in ("folders", "images", "image_tags")]
    return sizes[0].unionByName(sizes[1]).unionByName(sizes[2])


@query("wr12_thumbnails_below", f"SELECT thumbnail_path FROM images WHERE folder_id IN ({GONE}) AND thumbnail_path IS NOT NULL")
def wr12_thumbnails_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.folder_thumbnails(star_catalog(spark, sf_dir), 3)


@query("wr14_update_tag", "SELECT id, CASE WHEN id = 12 THEN 'Twelve' ELSE name END AS name, CASE WHEN id = 12 THEN NULL ELSE parent_id END AS parent_id, CASE WHEN id = 12 THEN 70 ELSE order_index END AS order_index FROM tags")
def wr14_update_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.update_tag(star_catalog(spark, sf_dir), 12, name="Twelve", parent_id=0, order_index=70).tags.drop("color")


@query("wr15_delete_tag", "SELECT t.id, nullif(parent_id, 1) AS parent_id, CAST(NULL AS BIGINT) AS links FROM tags t WHERE t.id <> 1 UNION ALL SELECT tag_id, NULL, count(*) FROM image_tags WHERE tag_id <> 1 GROUP BY tag_id")
def wr15_delete_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = writes.delete_tag(star_catalog(spark, sf_dir), 1)
    none = F.lit(None).cast("long")
    return c.tags.select("id", "parent_id", none.alias("links")).unionByName(stats.tag_counts(c).select(F.col("tag_id").alias("id"), none.alias("parent_id"), F.col("count").alias("links")))


@query("wr17_move_tag", "SELECT id, CASE WHEN n IS NULL THEN order_index ELSE (n - 1) * 100 END AS order_index, CASE WHEN id = 9 THEN 1 ELSE parent_id END AS parent_id FROM (SELECT t.*, n FROM tags t LEFT JOIN (SELECT id, row_number() OVER (ORDER BY CASE WHEN id = 9 THEN spot ELSE own END) AS n FROM (SELECT id, lpad(CAST(order_index AS VARCHAR), 5, '0') || name AS own, (SELECT lpad(CAST(order_index AS VARCHAR), 5, '0') || name || '!' FROM tags WHERE id = 4) AS spot FROM tags WHERE parent_id = 1 OR id = 9)) r USING (id))")
def wr17_move_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.move_tag(star_catalog(spark, sf_dir), 9, 4, "after").tags.select("id", "order_index", "parent_id")


# scalars


@query("sc1_like", "SELECT doc_id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%th_n%of the%'")
def sc1_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.like_nocase(F.col("text"), "%TH_n%of THE%")).select("doc_id")


@query("sc2_trigram", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ción')")
def sc2_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.trigram_contains(F.col("text"), "CIÓN")).select("doc_id")


@query("sc7_normalize", "SELECT page_id, coalesce(nullif(rtrim(url, '/'), ''), '/') AS path FROM pages")
def sc7_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.normalize(F.col("url")).alias("path"))


@query("sc8_path_parts", "SELECT id, CASE WHEN is_root THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '[^/]*$') AS base FROM folders")
def sc8_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return star_catalog(spark, sf_dir).folders.select("id", paths.parent(p).alias("parent"), paths.basename(p).alias("base"))


SIZED = "CASE WHEN size = 0 THEN '0 B' ELSE regexp_replace(printf('%.2f', round(size / pow(1024.0, k), 2)), '\\.?0+$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] END"


@query("sc13_format_size", f"SELECT id, {SIZED} AS label FROM (SELECT id, size * id AS size, CASE WHEN size * id >= pow(1024, 4) THEN 4 WHEN size * id >= pow(1024, 3) THEN 3 WHEN size * id >= pow(1024, 2) THEN 2 WHEN size * id >= 1024 THEN 1 ELSE 0 END AS k FROM images WHERE size IS NOT NULL)")
def sc13_format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_catalog(spark, sf_dir).images.where("size IS NOT NULL").select("id", media.format_size(F.col("size") * F.col("id")).alias("label"))


@query("sc16_labels", "SELECT id, CASE WHEN width IS NULL OR height IS NULL THEN 1.0::DOUBLE ELSE width / height END AS aspect, repeat('★', rating) AS stars, width || 'x' || height AS dimensions FROM images")
def sc16_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return star_catalog(spark, sf_dir).images.select("id", media.aspect_ratio(w, h).alias("aspect"), media.stars(F.col("rating")).alias("stars"), media.dimensions_label(w, h).alias("dimensions"))


QUALITY = "['low', 'Preview', 'MEDIUM', 'high', 'other'][o_orderkey % 5 + 1]"


@query("sc19_quality", f"SELECT o_orderkey AS id, CASE lower(q) WHEN 'low' THEN 28 WHEN 'preview' THEN 28 WHEN 'medium' THEN 23 WHEN 'high' THEN 18 END AS crf, CASE lower(q) WHEN 'low' THEN 'veryfast' WHEN 'preview' THEN 'veryfast' WHEN 'medium' THEN 'medium' WHEN 'high' THEN 'slow' END AS preset FROM (SELECT o_orderkey, {QUALITY} AS q FROM orders)")
def sc19_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.element_at(F.array(*map(F.lit, ("low", "Preview", "MEDIUM", "high", "other"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), media.quality_field(q, "crf").alias("crf"), media.quality_field(q, "preset").alias("preset"))


@query("sc21_stream_url", "SELECT id, CASE id % 3 WHEN 0 THEN 'audio://localhost/' || p WHEN 1 THEN 'video-stream://localhost/' || p || '?quality=preview' ELSE 'audio-stream://localhost/' || p || '?quality=high' END AS url FROM (SELECT id, replace(replace(replace(path, '/', '%2F'), '#', '%23'), ' ', '%20') AS p FROM folders)")
def sc21_stream_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id") % 3
    url = media.stream_url(F.col("path"), F.when(k == 1, "Video").otherwise("Audio"), F.when(k == 0, "Native").otherwise("Hls"), F.when(k == 2, "high"))
    return star_catalog(spark, sf_dir).folders.select("id", url.alias("url"))


@query("sc22_codecs", "SELECT event_id, (event_type NOT IN ('error', 'view')) AND (user_id % 4 <> 1) AS native FROM events")
def sc22_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    video = F.when(F.col("event_type") == "error", "hevc").when(F.col("event_type") == "view", "vp9").when(F.col("event_type") == "click", "h264")
    audio = F.when(F.col("user_id") % 4 == 1, "wma").when(F.col("user_id") % 4 == 2, "aac")
    return table(spark, sf_dir, "events").select("event_id", media.is_codec_native(video, audio).alias("native"))


@query("sc24_icons", "SELECT id, CASE WHEN lower(format) IN ('jpg', 'jpeg', 'png') THEN 'image' ELSE 'generic' END AS category, CASE WHEN lower(format) IN ('jpg', 'jpeg', 'png') THEN 'rgb(0, 160, 169)' ELSE 'rgb(120, 120, 120)' END AS color FROM images")
def sc24_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_catalog(spark, sf_dir).images.select("id", media.icon_category(F.col("format")).alias("category"), media.icon_color(F.col("format")).alias("color"))


@query("sc10_seconds_apart", "SELECT id, CAST(floor(abs(epoch_us(added_at) - epoch_us(modified_at)) / 1000000) AS BIGINT) AS seconds FROM images WHERE added_at IS NOT NULL")
def sc10_seconds_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cat(spark, sf_dir).images.where("added_at IS NOT NULL").select("id", text.seconds_apart(F.col("added_at"), F.col("modified_at")).cast("long").alias("seconds"))


@query("sc14_dates", "SELECT id, strftime(created_at, '%d/%m/%Y') AS day, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS plain, strftime(modified_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS rfc FROM images")
def sc14_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = F.col("created_at"), F.col("modified_at")
    return star_catalog(spark, sf_dir).images.select("id", F.date_format(c, "dd/MM/yyyy").alias("day"), text.plain_text(c).alias("plain"), text.rfc3339_text(m).alias("rfc"))


@query("sc15_to_bytes", "SELECT p_partkey AS id, CAST(floor(p_retailprice * 1024 + 0.5) AS BIGINT) AS kb, CAST(floor(p_retailprice * 1048576 + 0.5) AS BIGINT) AS mb FROM part")
def sc15_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), media.to_bytes(price, "KB").alias("kb"), media.to_bytes(price, "MB").alias("mb"))


EXTENSIONS = "['mp4', 'MKV', 'ogg', 'txt', 'mp3', 'swf']"


@query("sc20_playback", f"SELECT o_orderkey AS id, e NOT IN ('mp4', 'mp3') AS transcoded, CASE WHEN e IN ('ogg', 'mp3') THEN 'Audio' WHEN e = 'txt' THEN 'Unknown' ELSE 'Video' END AS media_type FROM (SELECT o_orderkey, lower({EXTENSIONS}[o_orderkey % 6 + 1]) AS e FROM orders)")
def sc20_playback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.element_at(F.array(*map(F.lit, ("mp4", "MKV", "ogg", "txt", "mp3", "swf"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("/v/a."), e).alias("path"))
    found = formats.detect(named, formats.registry(spark), content_col=None)
    kind = F.when(F.col("category").isin("Audio", "Video"), F.col("category")).otherwise("Unknown")
    return found.select("id", (~F.coalesce(F.col("playback") == "Native", F.lit(False))).alias("transcoded"), kind.alias("media_type"))


@query("sc23_segment_paths", "SELECT id, path AS file, id AS segment FROM folders")
def sc23_segment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat(media.url_encode(F.col("path")), F.lit("/"), F.col("id").cast("string"), F.lit(".ts"))
    return star_catalog(spark, sf_dir).folders.select("id", media.segment_of(address).alias("s")).select("id", "s.file", "s.segment")


@query("srt12_roots_sorted", "SELECT id, name, row_number() OVER (ORDER BY name, id) - 1 AS place FROM folders WHERE is_root OR parent_id IS NULL")
def srt12_roots_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return numbered(c.folders.where(F.col("is_root") | F.col("parent_id").isNull()).select("id", "name"), ["name", "id"])


@query("wr6_upsert_folder", "SELECT id, parent_id, path, is_root FROM folders WHERE id <> 101 UNION ALL SELECT id, NULL, path, true FROM folders WHERE id = 101 UNION ALL SELECT (SELECT max(id) + 1 FROM folders), 102, '/ASIA/new', false")
def wr6_upsert_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    path = c.folders.where("id = 101").first()["path"]
    c = writes.upsert_folder(c, path.lower(), "other", is_root=True)
    return writes.upsert_folder(c, "/ASIA/new/", "new", parent_id=102).folders.select("id", "parent_id", "path", "is_root")


@query("wr13_create_tag", "SELECT id, name, parent_id FROM tags UNION ALL SELECT (SELECT max(id) + 1 FROM tags), 'brand new', 1")
def wr13_create_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.create_tag(star_catalog(spark, sf_dir), "brand new", 1).tags.select("id", "name", "parent_id")


@query("wr16_unassign", "SELECT image_id, tag_id FROM image_tags WHERE NOT (image_id = 42 AND tag_id = (SELECT min(tag_id) FROM image_tags WHERE image_id = 42))")
def wr16_unassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return writes.unassign_tag(c, 42, c.image_tags.where("image_id = 42").agg(F.min("tag_id")).first()[0]).image_tags


# streams


@query("st2_tumbling", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st2_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.tumbling_counts(table(spark, sf_dir, "events"), "10 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


EVENTS = "SELECT '/r' AS root, event_id AS seq, CASE WHEN event_type IN ('error', 'view') THEN 'remove' ELSE 'upsert' END AS kind, '/u/' || user_id || '/' || regexp_extract(props, '[0-9]+') AS path, event_type = 'signup' AS is_dir, event_id AS size FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("error", "view"), "remove").otherwise("upsert")
    path = F.concat(F.lit("/u/"), "user_id", F.lit("/"), F.regexp_extract("props", "[0-9]+", 0))
    none = F.lit(None)
    return table(spark, sf_dir, "events").select(F.lit("/r").alias("root"), F.col("event_id").alias("seq"), kind.alias("kind"), path.alias("path"), none.cast("string").alias("to_path"), none.cast("long").alias("tracker"), (F.col("event_type") == "signup").alias("is_dir"), F.col("event_id").alias("size"), none.cast("timestamp").alias("created_at"))


COALESCED = "SELECT path, CASE WHEN arg_max(kind, seq) = 'remove' THEN 'remove' WHEN arg_max(is_dir, seq) THEN 'add_folder' ELSE 'add' END AS op, arg_max(size, seq) AS size FROM feed GROUP BY path"


@query("st3_coalesce", COALESCED, feed=EVENTS)
def st3_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.coalesce(_events(spark, sf_dir)).select("path", "op", "size")


@query(
    "st5_rename_pairs",
    "SELECT g.path, n.path AS to_path FROM (SELECT path, size, created_at, row_number() OVER (PARTITION BY size, created_at ORDER BY path) AS k FROM images WHERE format = 'jpg') g JOIN (SELECT '/new/' || id AS path, size, created_at, row_number() OVER (PARTITION BY size, created_at ORDER BY '/new/' || id) AS k FROM images WHERE format = 'jpg' AND starts_with(filename, 'Open_')) n ON g.size = n.size AND g.created_at = n.created_at AND g.k = n.k",
)
def st5_rename_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = star_catalog(spark, sf_dir).images
    none = F.lit(None).cast("string")
    row = ("size", "created_at")
    gone = images.where("format = 'jpg'").select(F.lit("/r").alias("root"), F.lit("remove").alias("op"), "path", none.alias("to_path"), F.lit(False).alias("is_dir"), *row)
    new = images.where("format = 'jpg' AND startswith(filename, 'Open_')").select(F.lit("/r").alias("root"), F.lit("add").alias("op"), F.concat(F.lit("/new/"), "id").alias("path"), none.alias("to_path"), F.lit(False).alias("is_dir"), *row)
    return changes.pair_untracked(gone.unionByName(new), images).where("op = 'rename'").select("path", "to_path")


@query(
    "st6_apply_batch",
    """SELECT 'updated' AS op, id AS image_id, nullif(folder_id, 0) AS old_folder_id FROM images WHERE format = 'jpg' AND width IS NOT NULL AND height IS NOT NULL AND format IS NOT NULL
    UNION ALL SELECT 'removed', id, NULL FROM images WHERE format = 'jpeg' UNION ALL SELECT 'updated', id, folder_id FROM images WHERE format = 'png'""",
)
def st6_apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, removals and rewritten files of one batch; the folders of the paths are new, so each rewritten or renamed image changes folder."""
    c = star_catalog(spark, sf_dir)
    kind = F.when(_is("jpg"), "rename").when(_is("jpeg"), "remove").otherwise("add")
    ops = c.images.where("format IN ('jpg', 'jpeg', 'png')").select(kind.alias("op"), "path", F.when(kind == "rename", F.concat(F.lit("/renamed/"), "id")).alias("to_path"), F.lit(False).alias("is_dir"))
    return apply_batch(c, ops, c.images.where("format = 'png'"), c.images).changes.select("op", "image_id", "old_folder_id")


@query("st7_due_removals", "SELECT path FROM images WHERE format = 'jpg' AND NOT starts_with(filename, 'Open_')")
def st7_due_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = star_catalog(spark, sf_dir).images
    since = F.when(F.col("filename").startswith("Open_"), F.timestamp_seconds(F.lit(999))).otherwise(F.timestamp_seconds(F.lit(998)))
    pending = images.where("format = 'jpg'").select("path", since.alias("since"))
    return changes.due_removals(pending, images, F.timestamp_seconds(F.lit(1000)))[0]


@query("st8_change_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def st8_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a stream that writes each batch's own and takes what there is."""
    out = shared_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("event_type").count().write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    changes.watch(source, shared_path(spark, "offsets"), handle, {"availableNow": True}).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("count").alias("n"))


@query("st10_next_batch", "SELECT id, path FROM images WHERE thumbnail_path IS NULL AND thumbnail_attempts < 3 ORDER BY id NOT IN (102, 150, 12), id LIMIT 6")
def st10_next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries.next_batch(star_catalog(spark, sf_dir).images, priority=[102, 150, 12])


@query(
    "st16_sessions",
    """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM
    (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""",
)
def st16_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.sessions(table(spark, sf_dir, "events"), "user_id", idle="30 minutes")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("st17_expired", "SELECT path FROM images WHERE TIMESTAMP '1998-01-01 00:00:00' - modified_at > INTERVAL 30 DAY")
def st17_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.expired(_cat(spark, sf_dir).images, "1998-01-01 00:00:00").select("path")


@query("ck_violations", "SELECT 'image_tags.tag_id' AS rule, CAST(tag_id AS VARCHAR) AS key, count(*) AS n FROM image_tags WHERE tag_id % 10 = 0 GROUP BY tag_id")
def ck_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = star_catalog(spark, sf_dir)
    return c.put(tags=c.tags.where("id % 10 > 0")).violations().where("rule = 'image_tags.tag_id'")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a page of a region's images, by name, notes, size and any of four tags."""
    asked = LibraryQuery(folder_id=3, recursive=True, tag_ids=(1, 2, 3, 4), search_query="order", advanced_query=predicate.to_json(both(crit("size", "gt", 50000))), sort_by="size", sort_order="desc", limit=100)
    return asked.to_df(star_catalog(spark, sf_dir))

