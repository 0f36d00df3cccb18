"""Library statistics: counts by tag and folder, recursive counts, and counters kept up to date from change batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.hierarchy import closure
from vitrine.operators.intervals import counts_below, intervals
from vitrine.sources.catalog import Catalog
from vitrine.sources.shared import few

CHANGES = "op string, image_id long, folder_id long, old_folder_id long, tag_ids array<long>"


def totals(catalog: Catalog) -> DataFrame:
    """(total_images, untagged_images)."""
    tagged = catalog.image_tags.select(F.col("image_id").alias("id")).distinct().withColumn("tagged", F.lit(True))
    met = catalog.images.select("id").join(tagged, "id", "left")
    return met.agg(F.count(F.lit(1)).alias("total_images"), F.count_if(F.col("tagged").isNull()).alias("untagged_images"))


def tag_counts(catalog: Catalog) -> DataFrame:
    """(tag_id, count) of the tags in use; a parent doesn't count its children's."""
    return catalog.image_tags.groupBy("tag_id").count()


def folder_counts(catalog: Catalog) -> DataFrame:
    """(folder_id, count) of the folders with images of their own."""
    return catalog.images.groupBy("folder_id").count()


def folder_counts_recursive(catalog: Catalog) -> DataFrame:
    """(folder_id, count) of every folder, its subfolders' images included.

    Images are counted by folder first, so a row a folder is summed along the tree's numbers.
    """
    own = catalog.images.groupBy(F.col("folder_id").alias("id")).count()
    return counts_below(intervals(catalog.folders), own).withColumnRenamed("id", "folder_id")


def counters(catalog: Catalog) -> DataFrame:
    """(kind, key, count): all of a library's counters as one table; kinds total, untagged, tag, folder, folder_recursive."""
    t = totals(catalog)
    none = F.lit(None).cast("long")
    parts = [
        t.select(F.inline(F.array(*(F.struct(F.lit(kind).alias("kind"), none.alias("key"), F.col(f"{kind}_images").alias("count")) for kind in ("total", "untagged"))))),
        tag_counts(catalog).select(F.lit("tag").alias("kind"), F.col("tag_id").alias("key"), "count"),
        folder_counts(catalog).select(F.lit("folder").alias("kind"), F.col("folder_id").alias("key"), "count"),
        folder_counts_recursive(catalog).select(F.lit("folder_recursive").alias("kind"), F.col("folder_id").alias("key"), "count"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def counter_deltas(changes: DataFrame, folders: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """(kind, key, removed, added) that a batch of changes (CHANGES) makes to counters().

    An added image counts as untagged. An update counts only if its folder changed. Folder changes reach all folders above; `ways` is closure(folders), where it is at hand.
    """
    one, zero = F.lit(1), F.lit(0)
    is_add, is_gone = F.col("op") == "added", F.col("op") == "removed"
    moved = (F.col("op") == "updated") & F.col("old_folder_id").isNotNull() & (F.col("old_folder_id") != F.col("folder_id"))
    no_tags = F.coalesce(F.size("tag_ids") <= 0, F.lit(True))

    def part(rows: DataFrame, kind: str, key, removed, added) -> DataFrame:
        key = F.lit(None).cast("long") if key is None else key
        return rows.select(F.lit(kind).alias("kind"), key.alias("key"), removed.alias("removed"), added.alias("added"))

    gone, added = changes.where(is_gone), changes.where(is_add)
    total = part(changes.where(is_gone | is_add), "total", None, is_gone.cast("int"), is_add.cast("int"))
    untagged = part(changes.where(is_add | (is_gone & no_tags)), "untagged", None, is_gone.cast("int"), is_add.cast("int"))
    tags = part(gone.select(F.explode("tag_ids").alias("tag_id")), "tag", F.col("tag_id"), one, zero)
    away = gone.unionByName(changes.where(moved).withColumn("folder_id", F.col("old_folder_id"))).select("folder_id", one.alias("removed"), zero.alias("added"))
    here = added.unionByName(changes.where(moved)).select("folder_id", zero.alias("removed"), one.alias("added"))
    by_folder = away.unionByName(here).where("folder_id IS NOT NULL").groupBy("folder_id").agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"))
    own = part(by_folder, "folder", F.col("folder_id"), F.col("removed"), F.col("added"))
    ways = (closure(folders) if ways is None else ways).select(F.col("id").alias("folder_id"), "ancestor")
    known = by_folder.join(few(ways), "folder_id", "left").withColumn("ancestor", F.coalesce("ancestor", "folder_id"))
    above = part(known, "folder_recursive", F.col("ancestor"), F.col("removed"), F.col("added"))
    found = total.unionByName(untagged).unionByName(tags).unionByName(own).unionByName(above)
    return found.groupBy("kind", "key").agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"))


def apply_deltas(current: DataFrame, deltas: DataFrame) -> DataFrame:
    """counters() after the deltas. Counters by key stop at zero when rows are removed, before any are added; the totals don't stop."""
    met = current.join(deltas, current["kind"].eqNullSafe(deltas["kind"]) & current["key"].eqNullSafe(deltas["key"]), "full")
    kind, key = F.coalesce(current["kind"], deltas["kind"]), F.coalesce(current["key"], deltas["key"])
    left = F.coalesce(current["count"], F.lit(0)) - F.coalesce("removed", F.lit(0))
    kept = F.when(kind.isin("total", "untagged"), left).otherwise(F.greatest(left, F.lit(0)))
    return met.select(kind.alias("kind"), key.alias("key"), (kept + F.coalesce("added", F.lit(0))).cast("long").alias("count"))


@dataclass(frozen=True)
class CounterLog:
    """counters() below the folder `path`, as a base and the deltas of batches after it; they are added up when read.

    A batch writes its deltas alone, however many counters there are, and replaces what it wrote before, so trying it again changes nothing. Sums are kept as they are
    and stop at zero only when read, so any order of batches and of compactions reads the same. compact() comes to a new base next to the old one; readers take the
    latest that is whole.
    """

    spark: SparkSession
    path: str

    def start(self, counters: DataFrame) -> None:
        counters.select("kind", "key", "count").write.mode("overwrite").parquet(f"{self.path}/base/upto=-1")

    def append(self, deltas: DataFrame, batch: int) -> None:
        """The deltas (counter_deltas()) of a batch; batches are numbered from 0, and one that a base has taken in is passed over."""
        if batch > self._upto():
            deltas.select("kind", "key", (F.col("added") - F.col("removed")).alias("count")).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def _base(self) -> DataFrame:
        return self.spark.read.schema("kind string, key long, count long, upto long").parquet(f"{self.path}/base")

    def _upto(self) -> int:
        return self._base().agg(F.max("upto")).first()[0]

    def _sums(self, last: int | None = None) -> DataFrame:
        upto = self._upto()
        rows = self._base().where(F.col("upto") == upto).select("kind", "key", "count")
        if self.batches():
            deltas = self.spark.read.schema("kind string, key long, count long, batch long").parquet(f"{self.path}/deltas").where(F.col("batch") > upto)
            rows = rows.unionByName((deltas if last is None else deltas.where(F.col("batch") <= last)).select("kind", "key", "count"))
        return rows.groupBy("kind", "key").agg(F.sum("count").alias("count"))

    def batches(self) -> int:
        """How many batches have deltas here."""
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deltas")
        system = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return len(system.listStatus(folder)) if system.exists(folder) else 0

    def compact(self, last: int) -> None:
        """A base that has all batches up to `last` in it; there must be none missing before it."""
        if last > self._upto():
            self._sums(last).write.mode("overwrite").parquet(f"{self.path}/base/upto={last}")

    def read(self) -> DataFrame:
        """(kind, key, count) as of the last batch; counters by key stop at zero."""
        kept = F.when(F.col("kind").isin("total", "untagged"), F.col("count")).otherwise(F.greatest("count", F.lit(0)))
        return self._sums().select("kind", "key", kept.alias("count"))
