"""What must wait between triggers: removals for their grace, halves of renames for each other."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from vitrine.streaming.changes import GRACE_SECONDS

_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries that are started inside keep their state where timers need it, in so many parts (a query's parts stay as they were when it first ran); the session's settings come back after that."""
    had = {name: spark.conf.get(name) for name in (_PROVIDER, _PARTITIONS)}
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if partitions:
        spark.conf.set(_PARTITIONS, str(partitions))
    try:
        yield
    finally:
        for name, value in had.items():
            spark.conf.set(name, value)


class _Grace(StatefulProcessor):
    """For each path the removal that waits: when it came, in microseconds, and its number."""

    def __init__(self, grace_us: int, event_time: bool):
        self.grace_us, self.event_time = grace_us, event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "since long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.pending.get() if self.pending.exists() else None
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        for row in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            at = row.at_us if self.event_time else now
            if held and at > held[0] + self.grace_us:
                yield Row(path=key[0], since_us=held[0], seq=held[1])
            held = (at, row.seq) if row.kind == "remove" else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.pending.update(held)
            self.handle.registerTimer((held[0] + self.grace_us) // 1000 + 1)
        else:
            self.pending.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            since, seq = self.pending.get()
            self.pending.clear()
            yield Row(path=key[0], since_us=since, seq=seq)

    def close(self) -> None:
        pass


def final_removals(events: DataFrame, grace_seconds: float = GRACE_SECONDS, late: str = "10 seconds", event_time: bool = True) -> DataFrame:
    """(path, since, seq) of each removal in the stream `events` (path, kind, seq, at) after which its path had no other event for `grace_seconds`.

    Removals wait in keyed state with a timer: by the events' own time, when the watermark (the latest `at` less `late`) has passed the grace, or else by the clock,
    from when they are read. An upsert in time takes the path back, a further removal starts the grace again; both end what waited longer. Rows older than the
    watermark are dropped. A path's rows of one trigger are sorted in its task: the source's files a trigger bound them. Rows without a path or a time take no part. Start it inside keyed_state().
    """
    rows = events.where("path IS NOT NULL AND at IS NOT NULL").select("path", "kind", "seq", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))
    rows = rows.withWatermark("at", late) if event_time else rows
    told = rows.groupBy("path").transformWithState(_Grace(int(grace_seconds * 1_000_000), event_time), "path string, since_us long, seq long", "Append", "EventTime" if event_time else "ProcessingTime")
    return told.select("path", F.timestamp_micros("since_us").alias("since"), "seq")


def met_halves(events: DataFrame, wait: str = "600 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(root, op, path, to_path, tracker, at) of a stream's rename halves `events` (root, kind, tracker, path, at): renames whose halves have met, and halves left alone.

    A second half belongs to the first of its root and tracker that came at most `wait` before it, in whatever triggers they are read. A first half that
    stays alone is a removal and a second one an upsert, as soon as the watermark (the latest `at` less `late`) says that none can come. Halves older than
    the watermark are dropped. Trackers must not come again within `wait`. Halves without a tracker stay alone.
    """
    timed = events.withWatermark("at", late)
    first = timed.where("kind = 'rename_from'").select(*(F.col(c).alias(f"from_{c}") for c in ("root", "tracker", "path", "at")))
    second = timed.where("kind = 'rename_to'").select(*(F.col(c).alias(f"to_{c}") for c in ("root", "tracker", "path", "at")))
    same = f"from_root = to_root AND from_tracker = to_tracker AND to_at >= from_at AND to_at <= from_at + INTERVAL {wait}"
    met = first.join(second, F.expr(same), "full")
    op = F.when(F.col("to_at").isNull(), "remove").when(F.col("from_at").isNull(), "upsert").otherwise("rename")
    both = lambda c: F.coalesce(f"from_{c}", f"to_{c}").alias(c)
    to_path = F.when(F.col("from_at").isNotNull(), F.col("to_path"))
    return met.select(both("root"), op.alias("op"), F.coalesce("from_path", "to_path").alias("path"), to_path.alias("to_path"), both("tracker"), F.coalesce("to_at", "from_at").alias("at"))
