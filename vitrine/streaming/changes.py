"""The change feed: file events become one batch of changes per trigger, the catalog follows, and so do its counters.

An event is (root, seq, kind, path, to_path, tracker, is_dir, ...). kind: upsert (there now), remove (gone), rename (path to to_path), rename_from
and rename_to (halves with a tracker, or without).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions.paths import parent
from vitrine.operators.stats import apply_deltas, counter_deltas
from vitrine.sources.shared import materialize

EVENTS = "root string, seq long, kind string, path string, to_path string, tracker long, is_dir boolean, size long, created_at timestamp"
#: What is done with a batch, in this order.
APPLY_ORDER = ("rename", "remove", "add_folder", "add")
TRIGGER, GRACE_SECONDS, TASKS_PER_BATCH = "600 milliseconds", 2, 100


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = TASKS_PER_BATCH) -> DataFrame:
    """Events as they arrive as parquet files in `path`; at most so many files a trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def pair_tracked(events: DataFrame) -> DataFrame:
    """`events` with the two halves of a rename, which have one tracker and come from one root, as one rename at the second's place.

    A first half without a second is a removal, a second without a first an upsert.
    """
    first = events.where("kind = 'rename_from' AND tracker IS NOT NULL").select("root", "tracker", F.col("path").alias("from_path"), F.col("seq").alias("from_seq"))
    halves = events.where("kind = 'rename_to' AND tracker IS NOT NULL").join(first, ["root", "tracker"]).where("from_seq < seq")
    near = F.row_number().over(Window.partitionBy("root", "seq").orderBy(F.desc("from_seq")))
    pairs = materialize(halves.withColumn("nth", near).where("nth = 1").drop("nth"), "pairs")
    renames = pairs.select(*(F.lit("rename").alias(c) if c == "kind" else F.col("from_path").alias(c) if c == "path" else F.col("path").alias("to_path") if c == "to_path" else F.col(c) for c in events.columns))
    used = pairs.select("root", "seq").unionByName(pairs.select("root", F.col("from_seq").alias("seq")))
    alone = events.join(used, ["root", "seq"], "left_anti").select(events.columns)
    kind = F.when(F.col("kind") == "rename_from", "remove").when(F.col("kind") == "rename_to", "upsert").otherwise(F.col("kind"))
    return alone.withColumn("kind", kind).unionByName(renames)


def coalesce(events: DataFrame) -> DataFrame:
    """(root, op, path, to_path, is_dir, size, created_at): what a batch of events comes to; op is rename, remove, add_folder or add.

    The last event of a path counts: what came and went is a removal, what went and came an addition. A rename of what came
    in the same batch is an addition at the new path. Only renames' own paths are followed, by joins of as many rounds as the longest such chain.
    """
    events = materialize(pair_tracked(events), "events")
    renames = events.where("kind = 'rename'")
    states = events.where("kind <> 'rename'").select("root", "path", "seq", "kind", "is_dir", "size", "created_at")
    while True:
        left = renames.select("root", F.col("path").alias("from_path"), F.col("to_path"), F.col("seq").alias("rename_seq"))
        before = states.join(left, (states["root"] == left["root"]) & (states["path"] == left["from_path"]) & (states["seq"] < left["rename_seq"])).select(states["*"], "to_path", "rename_seq")
        last = before.groupBy("root", "path", "rename_seq", "to_path").agg(F.max_by(F.struct("kind", "seq", "is_dir", "size", "created_at"), "seq").alias("was")).where("was.kind = 'upsert'")
        hits = materialize(last, "carried")
        if hits.isEmpty():
            break
        carried = hits.select("root", F.col("to_path").alias("path"), F.col("rename_seq").alias("seq"), F.lit("upsert").alias("kind"), "was.is_dir", "was.size", "was.created_at")
        taken = hits.select("root", "path", F.col("rename_seq").alias("seq"), F.lit("carried").alias("kind"), "was.is_dir", "was.size", "was.created_at")
        states = materialize(states.unionByName(carried).unionByName(taken), "states")
        renames = materialize(renames.join(hits.select("root", F.col("rename_seq").alias("seq")), ["root", "seq"], "left_anti").select(events.columns), "renames")
    final = states.groupBy("root", "path").agg(F.max_by(F.struct("kind", "is_dir", "size", "created_at"), F.struct("seq", F.when(F.col("kind") == "carried", 0).otherwise(1))).alias("last"))
    none = F.lit(None).cast("string")
    op = F.when(F.col("last.kind") == "remove", "remove").when(F.col("last.is_dir"), "add_folder").otherwise("add")
    done = final.where("last.kind <> 'carried'").select("root", op.alias("op"), "path", none.alias("to_path"), "last.is_dir", "last.size", "last.created_at")
    by_from = Window.partitionBy("root", "path").orderBy(F.desc("seq"))
    kept = renames.withColumn("nth", F.row_number().over(by_from)).where("nth = 1")
    return done.unionByName(kept.select("root", F.lit("rename").alias("op"), "path", "to_path", "is_dir", "size", "created_at"))


def pair_untracked(changes: DataFrame, images: DataFrame) -> DataFrame:
    """`changes` of coalesce() with removals and additions that look like a rename made one.

    A removal pairs with an added folder of the same parent, else, if it is an image of the catalog, with an added file of its
    size and creation time. The n-th removal of a key takes the n-th addition, by path.
    """
    gone = changes.where("op = 'remove'").select("root", "path", parent(F.col("path")).alias("above"))

    def matched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
        by = Window.partitionBy(*key).orderBy("path")
        a = left.withColumn("nth", F.row_number().over(by)).select(*key, "nth", "path")
        b = right.withColumn("nth", F.row_number().over(by)).select(*key, "nth", F.col("path").alias("to_path"))
        return a.join(b, [*key, "nth"]).select("root", "path", "to_path")

    folders = changes.where("op = 'add_folder'").select("root", "path", parent(F.col("path")).alias("above"))
    as_folder = matched(gone, folders, ["root", "above"]).withColumn("is_dir", F.lit(True))
    rest = gone.join(as_folder.select("root", "path"), ["root", "path"], "left_anti")
    known = rest.join(images.select("path", "size", "created_at"), "path")
    as_image = matched(known, changes.where("op = 'add'").select("root", "path", "size", "created_at"), ["root", "size", "created_at"]).withColumn("is_dir", F.lit(False))
    pairs = materialize(as_folder.unionByName(as_image), "pairs")
    used = pairs.select("root", F.col("path")).withColumn("op", F.lit("remove")).unionByName(pairs.select("root", F.col("to_path").alias("path"), F.when(F.col("is_dir"), "add_folder").otherwise("add").alias("op")))
    rest = changes.join(used, ["root", "path", "op"], "left_anti").select(changes.columns)
    none = F.lit(None)
    return rest.unionByName(pairs.select("root", F.lit("rename").alias("op"), "path", "to_path", "is_dir", none.cast("long").alias("size"), none.cast("timestamp").alias("created_at")))


def without_own(events: DataFrame, own_dir: str) -> DataFrame:
    """Events outside the folder `own_dir`, where this library keeps its own files."""
    own = own_dir.rstrip("/")
    inside = [F.coalesce((F.col(c) == own) | F.col(c).startswith(own + "/"), F.lit(False)) for c in ("path", "to_path")]
    return events.where(~(inside[0] | inside[1]))


def due_removals(pending: DataFrame, images: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(due, waiting) of `pending` (path, since): due are those of GRACE_SECONDS ago or more whose path the catalog still has; a move has taken the others."""
    old = F.unix_micros(now) - F.unix_micros("since") >= GRACE_SECONDS * 1_000_000
    due = pending.where(old).join(images.select("path"), "path", "left_semi")
    return due.select("path"), pending.where(~old)


def tumbling_counts(events: DataFrame, window: str = TRIGGER, at: str = "ts") -> DataFrame:
    """(window_start, event_type, n) of timed events, by windows that don't overlap."""
    return events.groupBy(F.window(at, window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@dataclass
class Counters:
    """The library's counters in the shared folder, brought up to date batch by batch.

    State is a new table for each batch, named by its number, so a batch that is tried again starts from the same state and comes to the same result.
    """

    path: str
    folders: DataFrame

    def start(self, counters: DataFrame) -> None:
        counters.write.mode("overwrite").parquet(f"{self.path}/before-0")

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        before = spark.read.parquet(f"{self.path}/before-{batch_id}")
        apply_deltas(before, counter_deltas(changes, self.folders)).write.mode("overwrite").parquet(f"{self.path}/before-{batch_id + 1}")

    def current(self, spark: SparkSession, batches: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/before-{batches}")


def watch(events: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], trigger: dict[str, object] | None = None):
    """Start a query that hands each trigger's events, if there are any, to `handle`. stop() on the query ends the watch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        if not df.isEmpty():
            handle(df, batch_id)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": TRIGGER})).start()


def sessions(events: DataFrame, key: str, at: str = "ts", idle: str = "60 seconds") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events that are at most `idle` apart; a session ends `idle` after its last."""
    found = events.groupBy(key, F.session_window(at, idle).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
