"""Sharding by jump consistent hashing, with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that each shard's rows are numbered in; shards x SLOT_PIECES counts are broadcast, whatever the input.
SLOT_PIECES = 1024


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the jump-consistent-hash bucket of `key` among `shards`, and among `shards` + 1.

    The bucket jumps forward through the shard counts at which the key would have moved; the k-th
    jump draws its uniform number from xxhash64(k, key), so a jump below n is the same for every
    shard count above n, and adding one shard moves a key into the new shard or leaves it.
    Jumps strictly ascend, so `shards` + 1 steps always suffice. Null keys hash as any value does.
    """
    last = F.lit(shards).cast("double")

    def jump(at: Column, k: Column) -> Column:
        uniform = (F.shiftrightunsigned(F.xxhash64(k, key), 33) + F.lit(1)).cast("double") / F.lit(float(1 << 31))
        ahead = F.floor((at["next"] + F.lit(1.0)) / uniform).cast("double")
        moves = at["next"] <= last
        return F.struct(
            F.when(at["next"] < last, at["next"]).otherwise(at["shard"]).alias("shard"),
            F.when(moves, at["next"]).otherwise(at["grown"]).alias("grown"),
            F.when(moves, ahead).otherwise(at["next"]).alias("next"),
        )

    zero = F.lit(0.0)
    ended = F.aggregate(
        F.sequence(F.lit(0), F.lit(shards + 1)),
        F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("next")),
        jump,
    )
    return F.struct(ended["shard"].cast("int").alias("shard"), ended["grown"].cast("int").alias("grown"))


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row in one of `shards` shards by its id and the shard count alone (law `key`).

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot (gapless from 0
    in its shard) and grown_shard (the shard among one more). A null text counts as empty; a null id is
    placed like any other value; repeated rows are placed one by one in the same shard; an empty table
    gives none. Equal texts are not kept together, since only the id decides. Other columns are left out,
    so their names can't clash.

    Slots: the rows of a shard are numbered in SLOT_PIECES pieces by hash of the id, each a window of its
    own, and the pieces' offsets come from their counts. No shard passes through one task whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    at = jump_shards(F.col("doc_id"), shards)
    piece = F.pmod(F.xxhash64(F.lit("slot"), F.col("doc_id")), F.lit(SLOT_PIECES)).cast("int")

    counts = docs.select(F.col(id_col).alias("doc_id")).select(at["shard"].alias("shard"), piece.alias("piece")).groupBy("shard", "piece").count()
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))

    inside = Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size")
    numbered = (
        placed.withColumn("at", at)
        .select("*", F.col("at.shard").alias("shard"), F.col("at.grown").alias("grown_shard"), piece.alias("piece"))
        .withColumn("nth", F.row_number().over(inside))
    )
    # at most shards x SLOT_PIECES rows are broadcast
    return numbered.join(F.broadcast(offsets), ["shard", "piece"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
