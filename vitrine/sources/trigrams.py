"""An inverted table of trigrams, for `contains` searches that read the rows which can match instead of all.

Rows are kept in slices by a hash of their id, postings (gram, id) in order of the gram. An update writes a generation of postings for the changed rows alone;
older postings of these rows are dead from then on, and compact() leaves them out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import trigram_contains
from vitrine.sources.shared import materialize

#: Slices of the rows; a search reads those that hold a candidate.
SLICES = 64
#: Of a pattern's grams so many, the rarest, choose the candidates; these are compared with the whole pattern anyhow.
GRAMS = 4


def _distinct_grams(low: pa.Array) -> pa.Array:
    """Per text its distinct runs of three characters."""
    found = [pa.array({t[k : k + 3] for k in range(len(t) - 2)}, pa.string()) for t in (text.as_py() or "" for text in low)]
    ends = np.cumsum([0, *map(len, found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(found) if found else pa.array([], pa.string()))


def grams_of(text: Column) -> Column:
    """The distinct trigrams of `text` with all letters' case folded, as an array; none for null and for less than 3 characters."""
    return F.arrow_udf(_distinct_grams, "array<string>")(F.lower(text))


def pattern_grams(pattern: str) -> list[str]:
    """The distinct trigrams of a pattern, folded as text.trigram_contains() folds it."""
    low = pattern.lower()
    return sorted({low[k : k + 3] for k in range(len(low) - 2)})


@dataclass(frozen=True)
class TrigramIndex:
    """The index below the folder `path`, over rows (id, text). Writers take turns; a generation that is written again replaces itself."""

    spark: SparkSession
    path: str
    slices: int = SLICES

    def _slice(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(self.slices)).cast("int"))

    def _put(self, rows: DataFrame, generation: int) -> None:
        found = materialize(rows.select("id", F.explode(grams_of(F.col("text"))).alias("gram")), "grams")
        ranged = found.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")  # by id too, so that a frequent gram is many ranges
        ranged.write.mode("overwrite").parquet(f"{self.path}/postings/generation={generation}")
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.path}/counts/generation={generation}")

    def build(self, rows: DataFrame) -> TrigramIndex:
        """Index `rows` (id, text) as generation 0. Ids must differ and not be null; null texts are kept and never match."""
        rows = rows.select("id", "text")
        self._slice(rows).repartition("slice").sortWithinPartitions("slice", "id").write.partitionBy("slice").parquet(f"{self.path}/rows")
        self._put(rows, 0)
        rows.where("false").select("id").write.mode("overwrite").parquet(f"{self.path}/changed/generation=0")
        return self

    def update(self, changed: DataFrame, generation: int) -> None:
        """Take `changed` (id, text, gone) in, as a generation above all before: new texts, or with `gone` no row. Only the slices of changed rows are written again."""
        changed = materialize(self._slice(changed.select("id", "text", F.coalesce("gone", F.lit(False)).alias("gone"))), "changed")
        hit = [r["slice"] for r in changed.select("slice").distinct().collect()]  # `slices` at most
        if hit:
            rows = self._rows().where(F.col("slice").isin(*hit)).join(changed.select("id"), "id", "left_anti")
            after = materialize(rows.select("id", "text", "slice").unionByName(changed.where("NOT gone").select("id", "text", "slice")), "slices")
            after.repartition("slice").sortWithinPartitions("slice", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(f"{self.path}/rows")
            held = after.select("slice").distinct().withColumn("held", F.lit(True))
            empty = changed.select("slice").distinct().join(held, "slice", "left_anti")
            for row in empty.collect():  # slices that lost their last row
                self._rows().where("false").select("id", "text").write.mode("overwrite").parquet(f"{self.path}/rows/slice={row['slice']}")
        changed.select("id").write.mode("overwrite").parquet(f"{self.path}/changed/generation={generation}")
        self._put(changed.where("NOT gone"), generation)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema("id long, text string, slice int").parquet(f"{self.path}/rows")

    def _live(self, postings: DataFrame) -> DataFrame:
        """Postings (id, generation, ...) whose id hasn't changed since."""
        changed = self.spark.read.schema("id long, generation int").parquet(f"{self.path}/changed").groupBy("id").agg(F.max("generation").alias("since"))
        return postings.join(changed, "id", "left").where("since IS NULL OR since <= generation").drop("since")

    def candidates(self, pattern: str) -> DataFrame:
        """(id) of the rows that have the pattern's rarest grams, from their posting lists alone."""
        none = self.spark.createDataFrame([], "id long")
        grams = pattern_grams(pattern)
        if not grams:
            return none
        counts = self.spark.read.schema("gram string, n long, generation int").parquet(f"{self.path}/counts").where(F.col("gram").isin(*grams))
        known = counts.groupBy("gram").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()  # a row for each of the pattern's grams at most
        if len(known) < len(grams):
            return none
        chosen = [r["gram"] for r in known[:GRAMS]]
        postings = self.spark.read.schema("id long, gram string, generation int").parquet(f"{self.path}/postings").where(F.col("gram").isin(*chosen))
        return self._live(postings).groupBy("id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(chosen)).select("id")

    def contains(self, pattern: str) -> DataFrame:
        """(id, text) of the rows whose text has `pattern` in it, whatever the case; under 3 characters finds nothing. Slices without a candidate aren't read."""
        found = materialize(self._slice(self.candidates(pattern)), "candidates")
        hit = [r["slice"] for r in found.select("slice").distinct().collect()]
        rows = self._rows().where(F.col("slice").isin(*hit) if hit else F.lit(False))
        return rows.join(found, ["slice", "id"], "left_semi").where(trigram_contains(F.col("text"), pattern)).select("id", "text")

    def compact(self, path: str) -> TrigramIndex:
        """The same index at `path`, as one generation without dead postings."""
        new = TrigramIndex(self.spark, path, self.slices)
        postings = self.spark.read.schema("id long, gram string, generation int").parquet(f"{self.path}/postings")
        live = materialize(self._live(postings).select("id", "gram"), "live")
        live.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings/generation=0")
        live.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts/generation=0")
        live.where("false").select("id").write.parquet(f"{path}/changed/generation=0")
        self._rows().repartition("slice").sortWithinPartitions("slice", "id").write.partitionBy("slice").parquet(f"{path}/rows")
        return new
