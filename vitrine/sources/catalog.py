"""The catalog: tables of assets, folders, tags, their links, saved searches and settings."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.sources.shared import shared_path, table

# Columns of each table; times are timestamps, and become text only where a search compares them as text.
SCHEMAS = {
    "folders": "id long, parent_id long, path string, name string, is_root boolean",
    "images": "id long, folder_id long, path string, filename string, width int, height int, size long, format string, rating int, notes string, created_at timestamp, modified_at timestamp, added_at timestamp, thumbnail_path string, thumbnail_attempts int, thumbnail_last_error string",
    "tags": "id long, name string, parent_id long, color string, order_index long",
    "image_tags": "image_id long, tag_id long",
    "smart_folders": "id long, name string, query_json string",
    "app_settings": "key string, value string",
}
#: Columns that a search returns.
RESULT = ("id", "path", "filename", "width", "height", "size", "thumbnail_path", "format", "rating", "notes", "created_at", "modified_at", "added_at")


@dataclass(frozen=True)
class Catalog:
    """Immutable: each write returns a catalog with new tables, and save() writes it."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            tables = self.__dict__["tables"]
            return tables[name] if name in tables else self.spark.createDataFrame([], SCHEMAS[name])
        raise AttributeError(name)

    def put(self, **tables: DataFrame) -> Catalog:
        return replace(self, tables={**self.tables, **tables})

    def save(self, path: str) -> Catalog:
        """Write every table as parquet below `path` (a new folder), and go on from there."""
        for name in SCHEMAS:
            getattr(self, name).write.parquet(f"{path}/{name}")
        return load(self.spark, path)

    def materialized(self) -> Catalog:
        return self.save(shared_path(self.spark, "catalog"))

    def violations(self) -> DataFrame:
        """(rule, key, n) of what breaks the rules: paths and names that repeat, links that repeat or lead nowhere."""

        def repeated(rule: str, df: DataFrame, *columns: str) -> DataFrame:
            key = F.concat_ws("/", *(F.col(c).cast("string") for c in columns))
            return df.groupBy(key.alias("key")).count().where("count > 1").select(F.lit(rule).alias("rule"), "key", F.col("count").alias("n"))

        def dangling(rule: str, df: DataFrame, column: str, to: DataFrame) -> DataFrame:
            lost = df.where(F.col(column).isNotNull()).join(to.select(F.col("id").alias(column)), column, "left_anti")
            return lost.groupBy(F.col(column).cast("string").alias("key")).count().select(F.lit(rule).alias("rule"), "key", F.col("count").alias("n"))

        parts = [
            repeated("folders.path", self.folders, "path"),
            repeated("images.path", self.images, "path"),
            repeated("tags.name", self.tags, "name"),
            repeated("image_tags", self.image_tags, "image_id", "tag_id"),
            dangling("folders.parent_id", self.folders, "parent_id", self.folders),
            dangling("images.folder_id", self.images, "folder_id", self.folders),
            dangling("image_tags.image_id", self.image_tags, "image_id", self.images),
            dangling("image_tags.tag_id", self.image_tags, "tag_id", self.tags),
        ]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found


def load(spark: SparkSession, path: str) -> Catalog:
    return Catalog(spark, {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The star schema's tables seen as a catalog: orders are assets in a tree of regions, nations and customers, tagged by suppliers."""
    region, nation, customer, orders, supplier, lineitem = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "supplier", "lineitem"))
    regions = region.selectExpr("CAST(r_regionkey + 1 AS LONG) AS id", "CAST(NULL AS LONG) AS parent_id", "'/' || r_name AS path", "r_name AS name", "true AS is_root")
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("CAST(n_nationkey + 100 AS LONG) AS id", "CAST(n_regionkey + 1 AS LONG) AS parent_id", "'/' || r_name || '/' || n_name AS path", "n_name AS name", "false AS is_root")
    n = nations.select(F.col("id").alias("nation_id"), F.col("path").alias("nation_path"))
    customers = customer.join(F.broadcast(n), F.col("c_nationkey") + 100 == F.col("nation_id")).selectExpr("c_custkey + 1000 AS id", "nation_id AS parent_id", "nation_path || '/' || c_name AS path", "c_name AS name", "false AS is_root")
    images = orders.selectExpr(
        "o_orderkey AS id",
        "o_custkey + 1000 AS folder_id",
        "'/orders/' || o_custkey || '/Order_' || o_orderkey AS path",
        "CASE o_orderstatus WHEN 'F' THEN 'Filled_' WHEN 'O' THEN 'Open_' ELSE 'part.' END || o_orderkey || '.' || substr(o_orderpriority, 1, 1) AS filename",
        "CAST(CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 4000 + 1 END AS INT) AS width",
        "CAST(CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 3000 + 1 END AS INT) AS height",
        "CASE WHEN o_orderkey % 17 > 0 THEN CAST(floor(o_totalprice) AS LONG) END AS size",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'jpg' WHEN '2-HIGH' THEN 'jpeg' WHEN '3-MEDIUM' THEN 'png' WHEN '4-NOT SPECIFIED' THEN 'JPG' END AS format",
        "CAST(o_orderkey % 6 AS INT) AS rating",
        "CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority || ' order of ' || o_custkey END AS notes",
        "o_orderdate AS created_at",
        "o_orderdate + make_dt_interval(CAST(o_orderkey % 50 AS INT)) AS modified_at",
        "CASE WHEN o_orderkey % 13 > 0 THEN o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)) END AS added_at",
        "CASE WHEN o_orderkey % 3 > 0 THEN 'thumb/' || o_orderkey || '.webp' END AS thumbnail_path",
        "CAST(o_orderkey % 5 AS INT) AS thumbnail_attempts",
        "CAST(NULL AS STRING) AS thumbnail_last_error",
    )
    tags = supplier.selectExpr("s_suppkey + 1 AS id", "s_name AS name", "CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey - s_suppkey % 10 + 1 END AS parent_id", "CAST(NULL AS STRING) AS color", "s_suppkey % 7 AS order_index")
    image_tags = lineitem.selectExpr("l_orderkey AS image_id", "l_suppkey + 1 AS tag_id").distinct()
    return Catalog(spark, {"folders": regions.unionByName(nations).unionByName(customers), "images": images, "tags": tags, "image_tags": image_tags})
