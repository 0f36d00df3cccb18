"""Feeds whose readers see every batch once, however often a batch was tried."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from vitrine.streaming.changes import TRIGGER


@dataclass(frozen=True)
class Ledger:
    """A feed below the folder `path`: each batch's rows, and a commit with their number that is written after them.

    A batch that fails before its commit is written again over what it left; one that comes again after its commit is passed over. Readers
    take committed batches alone. Batches without rows are committed and have no rows.
    """

    spark: SparkSession
    path: str

    def committed(self) -> DataFrame:
        """(batch, n): what readers see, by the numbers of batches."""
        try:
            return self.spark.read.schema("n long, batch long").parquet(f"{self.path}/commits")
        except Exception as missing:  # nothing was committed yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], "n long, batch long")

    def put(self, rows: DataFrame, batch: int) -> bool:
        """Write `rows` as batch number `batch`; false if that batch is there already."""
        if not self.committed().where(F.col("batch") == batch).isEmpty():
            return False
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/batch={batch}").agg(F.count(F.lit(1)).alias("n"))
        n.write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def rows(self, schema: str) -> DataFrame:
        """The rows (`schema`, batch) of committed batches."""
        found = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/rows")
        return found.join(self.committed().select("batch"), "batch", "left_semi")


def feed(events: DataFrame, ledger: Ledger, checkpoint: str, fold: Callable[[DataFrame], DataFrame], trigger: dict[str, object] | None = None, name: str | None = None) -> StreamingQuery:
    """Start a query that puts `fold` of each trigger's events into `ledger`, by default every 600 ms. With its checkpoint it goes on where it was stopped or died."""
    writer = events.writeStream.foreachBatch(lambda df, batch: ledger.put(fold(df), batch)).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(**(trigger or {"processingTime": TRIGGER})).start()


class Progress(StreamingQueryListener):
    """What queries report, the latest `most` reports: started, then a report a trigger with its batch and rows, then complete or failed."""

    def __init__(self, most: int = 1000):
        self.reports: deque[tuple[str, str | None, int | None, int | None]] = deque(maxlen=most)
        self.names: dict[str, str | None] = {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name
        self.reports.append(("started", event.name, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append(("progress", p.name, p.batchId, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.reports.append(("failed" if event.exception else "complete", self.names.get(str(event.id)), None, None))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.reports), "report string, name string, batch long, n long")
