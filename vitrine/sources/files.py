"""Directories as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.paths import basename, extension, normalize, parent
from vitrine.sources.formats import HEAD_BYTES, registry, supported


def scan_directory(spark: SparkSession, root: str, with_head: bool = False) -> DataFrame:
    """(path, folder, filename, format, size, modified_at[, head]) of every supported file below `root`, by any file system Spark reads.

    Without `with_head` no content is read. Files that can't be read are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(root)
    plain = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    told = files.select(
        normalize(plain).alias("path"),
        parent(plain).alias("folder"),
        basename(plain).alias("filename"),
        extension(plain).alias("format"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
        *([F.substring("content", 1, HEAD_BYTES).alias("head")] if with_head else []),
    )
    return supported(told, registry(spark))


def _number(c: Column, at: Column, size: int, little: bool | Column = False) -> Column:
    """`size` bytes of `c` from `at` on (from 0) as a number; null where they aren't all there. little: whether the lowest comes first."""
    code = F.hex(F.substring(c, (at + 1).cast("int"), F.lit(size)))
    turned = F.concat(*(F.substring(code, 2 * k + 1, 2) for k in reversed(range(size))))
    chosen = turned if little is True else code if little is False else F.when(little, turned).otherwise(code)
    return F.when((at >= 0) & (at + size <= F.length(c)), F.conv(chosen, 16, 10).cast("long"))


def _starts(c: Column, code: str, at: int = 0) -> Column:
    return F.hex(F.substring(c, at + 1, len(code) // 2)) == code


_SIZE = "struct<at:bigint,width:bigint,height:bigint>"


def _jpeg_size(c: Column) -> Column:
    """Segment after segment, each of the length that it tells, up to the one of a frame; a frame beyond the bytes at hand has no size."""

    def step(x: Column, _: Column) -> Column:
        at = x["at"]
        marker, length = _number(c, at + 1, 1), _number(c, at + 2, 2)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        alone = (marker == 0x01) | marker.between(0xD0, 0xD8)
        ended = (at < 0) | marker.isNull() | (_number(c, at, 1) != 0xFF) | marker.isin(0xD9, 0xDA)
        to = F.when(ended | frame, F.lit(-1)).when(marker == 0xFF, at + 1).when(alone, at + 2).otherwise(F.coalesce(at + 2 + length, F.lit(-1)))
        found = ~ended & frame
        width, height = (F.when(found, _number(c, at + k, 2)).otherwise(x[n]) for k, n in ((7, "width"), (5, "height")))
        return F.when(at < 0, x).otherwise(F.struct(to.cast("long").alias("at"), width.alias("width"), height.alias("height")))

    none = F.lit(None).cast("long")
    turns = F.sequence(F.lit(1), F.greatest(F.length(c) / 4, F.lit(1)).cast("int"))  # no segment is shorter
    return F.aggregate(turns, F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height")), step)


def _tiff_size(c: Column) -> Column:
    """The first directory's entries for width and height, of 2 or 4 bytes."""
    little = _starts(c, "49492A00")
    begin = _number(c, F.lit(4), 4, little)
    n = F.coalesce(_number(c, begin, 2, little), F.lit(0))

    def step(x: Column, k: Column) -> Column:
        at = begin + 2 + 12 * k
        tag, kind = _number(c, at, 2, little), _number(c, at + 2, 2, little)
        value = F.when(kind == 3, _number(c, at + 8, 2, little)).when(kind == 4, _number(c, at + 8, 4, little))
        return F.struct(x["at"].alias("at"), *(F.when(tag == t, value).otherwise(x[name]).alias(name) for t, name in ((256, "width"), (257, "height"))))

    none = F.lit(None).cast("long")
    entries = F.sequence(F.lit(0), F.greatest(F.least(n, F.length(c) / 12).cast("int"), F.lit(1)) - 1)
    return F.aggregate(entries, F.struct(F.lit(0).cast("long").alias("at"), none.alias("width"), none.alias("height")), step)


def header_dimensions(head: DataFrame, content_col: str = "head") -> DataFrame:
    """Add width and height as the headers of PNG, GIF, BMP, JPEG, WebP and TIFF files tell them; null for others, and where the bytes at hand don't reach them.

    JPEG segments and TIFF entries are walked by folds over the binary column, so all of it is expressions.
    """
    c = F.col(content_col)
    at = lambda k, size, little: _number(c, F.lit(k), size, little)
    bits = at(21, 4, True)
    rows = [
        (_starts(c, "89504E47"), at(16, 4, False), at(20, 4, False)),
        (_starts(c, "474946"), at(6, 2, True), at(8, 2, True)),
        (_starts(c, "424D"), at(18, 4, True), at(22, 4, True)),
        (_starts(c, "FFD8FF"), F.col("jpeg.width"), F.col("jpeg.height")),
        (_starts(c, "49492A00") | _starts(c, "4D4D002A"), F.col("tiff.width"), F.col("tiff.height")),
    ]
    webp = _starts(c, "52494646") & _starts(c, "57454250", 8)
    rows += [
        (webp & _starts(c, "56503820", 12), at(26, 2, True).bitwiseAND(0x3FFF), at(28, 2, True).bitwiseAND(0x3FFF)),
        (webp & _starts(c, "5650384C", 12), bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1),
        (webp & _starts(c, "56503858", 12), at(24, 3, True) + 1, at(27, 3, True) + 1),
    ]
    jpeg = F.when(_starts(c, "FFD8FF"), _jpeg_size(c).cast(_SIZE)).alias("jpeg")
    tiff = F.when(_starts(c, "49492A00") | _starts(c, "4D4D002A"), _tiff_size(c).cast(_SIZE)).alias("tiff")
    width = height = F.lit(None).cast("long")
    for is_kind, w, h in reversed(rows):
        width, height = F.when(is_kind, w).otherwise(width), F.when(is_kind, h).otherwise(height)
    kept = [x for x in head.columns if x.lower() not in ("width", "height")]
    walked = head.select(F.struct(*kept).alias("row"), F.col(content_col).alias(content_col), jpeg, tiff)
    return walked.select("row.*", width.cast(T.IntegerType()).alias("width"), height.cast(T.IntegerType()).alias("height"))


def file_metadata(scanned: DataFrame, content_col: str = "head") -> DataFrame:
    """A scan_directory() with bytes as a library takes it in: width and height from the header, created_at (file systems tell no other time than the last change), without the bytes.

    Files without an extension are none of a library's.
    """
    told = header_dimensions(scanned.where(F.coalesce(F.col("format"), F.lit("")) != ""), content_col)
    return told.withColumn("created_at", F.col("modified_at")).drop(content_col)


def cache_usage(files: DataFrame) -> DataFrame:
    """(files, bytes) of all rows of a scan."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def expired(files: DataFrame, now: str, days: int = 30) -> DataFrame:
    """The rows last modified over `days` days before `now`."""
    return files.where(F.to_timestamp(F.lit(now)) - F.col("modified_at") > F.expr(f"INTERVAL {int(days)} DAYS"))
