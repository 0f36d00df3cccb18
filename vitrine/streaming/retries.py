"""Work queues with retries, and histories of searches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, ATTEMPTS, HISTORY = 6, 3, 50


def next_batch(images: DataFrame, priority: Iterable[int] = (), size: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """(id, path) of up to `size` images without a thumbnail that were tried under `attempts` times: those in `priority` first, then by id."""
    first = F.col("id").isin(*priority) if (priority := list(priority)) else F.lit(False)
    wanted = images.where(F.col("thumbnail_path").isNull() & (F.col("thumbnail_attempts") < attempts))
    return wanted.orderBy(first.desc(), "id").limit(size).select("id", "path")


def drain(read: Callable[[], DataFrame], work: Callable[[DataFrame], None], priority: Iterable[int] = ()) -> int:
    """Hand batches to `work`, which must set a path or count an attempt, until none is left; how many there were."""
    n = 0
    while not (batch := next_batch(read(), priority)).isEmpty():
        work(batch)
        n += 1
    return n


@dataclass
class History:
    """The last searches, with undo and redo. What equals the current one isn't added, and adding drops what could be redone."""

    most: int = HISTORY
    items: list[str] = field(default_factory=list)
    at: int = -1

    def push(self, query: str) -> None:
        if self.at >= 0 and self.items[self.at] == query:
            return
        self.items = [*self.items[: self.at + 1], query][-self.most :]
        self.at = len(self.items) - 1

    def undo(self) -> str | None:
        self.at = max(self.at - 1, 0) if self.items else -1
        return self.items[self.at] if self.items else None

    def redo(self) -> str | None:
        self.at = min(self.at + 1, len(self.items) - 1)
        return self.items[self.at] if self.items else None
