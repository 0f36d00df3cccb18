"""Media metadata: sizes, qualities, codecs, stream addresses, segments and waveforms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of sizes, each 1024 of the one before.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")

# Quality, other name, label, CRF, video and audio bits a second, preset.
QUALITIES = (
    ("preview", "low", "Preview", 28, 4_000_000, 192_000, "veryfast"),
    ("standard", "medium", "Standard", 23, 8_000_000, 256_000, "medium"),
    ("high", None, "High", 18, 15_000_000, 320_000, "slow"),
)
QUALITY_COLUMNS = "name string, alias string, label string, crf int, video_bitrate int, audio_bitrate int, preset string"

# Codecs that play without transcoding.
NATIVE_VIDEO = ("h264", "avc1", "avc", "vp8")
NATIVE_AUDIO = ("aac", "mp3", "mp2", "flac", "pcm_s16le", "pcm_s24le", "pcm_f32le", "opus", "vorbis")

# Extensions and containers that don't seek well in segments.
LINEAR_EXTENSIONS = ("swf", "m2v", "mpv", "mpg", "mpeg")
LINEAR_CONTAINERS = ("swf", "mpeg1video", "mpegvideo", "m2v", "mpegps")

# Icon category, colour, extensions.
ICONS = (
    ("file3d", "rgb(50, 50, 180)", "c4d 3ds obj fbx blend stl dae skp dwg dxf max lwo lws ma mb gltf glb"),
    ("font", "rgb(80, 80, 80)", "ttf otf ttc woff woff2 eot fon fnt"),
    ("design", "rgb(234, 76, 137)", "cdr indd xd fig sketch ai eps psd afdesign afphoto afpub"),
    ("code", "rgb(44, 62, 80)", "html css js ts jsx tsx json xml svg py rs go c cpp java"),
    ("video", "rgb(229, 9, 20)", "mp4 mov avi mkv webm flv wmv"),
    ("audio", "rgb(30, 215, 96)", "mp3 wav ogg flac aac m4a"),
    ("archive", "rgb(255, 165, 0)", "zip rar 7z tar gz bz2"),
    ("image", "rgb(0, 160, 169)", "jpg jpeg png gif bmp webp tiff tif heic heif raw cr2 nef arw"),
)
GENERIC_ICON = ("generic", "rgb(120, 120, 120)")

#: Points of a waveform, seconds of a segment.
WAVEFORM_POINTS, SEGMENT_SECONDS = 500, 10.0


def format_size(size: Column) -> Column:
    """Bytes for readers: base 1024, at most two decimals, zeros at the end cut. Null stays null; a size below 1 counts bytes."""
    power = F.least(F.lit(len(SIZE_UNITS) - 1), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double")) / 10))).cast("int")
    value = F.round(size / F.pow(F.lit(1024.0), power), 2)
    number = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    unit = F.element_at(F.array(*map(F.lit, SIZE_UNITS)), power + 1)
    return F.when(size == 0, "0 B").otherwise(F.concat_ws(" ", number, unit))


def to_bytes(value: Column, unit: str) -> Column:
    """`value` in the unit B, KB, MB or GB as whole bytes, halves up."""
    return F.floor(value * 1024 ** SIZE_UNITS.index(unit) + 0.5).cast("long")


def aspect_ratio(width: Column, height: Column) -> Column:
    """width / height, or 1 where either is missing or not above zero."""
    return F.when((width > 0) & (height > 0), width / height).otherwise(1.0)


def stars(rating: Column) -> Column:
    return F.repeat(F.lit("★"), F.greatest(F.coalesce(rating, F.lit(0)), F.lit(0)))


def dimensions_label(width: Column, height: Column) -> Column:
    return F.when(width.isNotNull() & height.isNotNull(), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def quality_field(quality: Column, field: str) -> Column:
    """A column of QUALITY_COLUMNS by the quality's name or other name, in any case; null for others."""
    at = [c.split()[0] for c in QUALITY_COLUMNS.split(", ")].index(field)
    folded, found = F.lower(quality), F.lit(None)
    for row in QUALITIES:
        found = F.when(folded.isin([x for x in row[:2] if x]), row[at]).otherwise(found)
    return found


def is_codec_native(video: Column, audio: Column) -> Column:
    """Whether a file with these codecs (null: no such stream) plays without transcoding."""
    return F.coalesce(video.isin(*NATIVE_VIDEO), F.lit(True)) & F.coalesce(audio.isin(*NATIVE_AUDIO), F.lit(True))


def is_linear(extension: Column, container: Column) -> Column:
    """Whether a file is streamed from its start on, as it doesn't seek well."""
    return F.coalesce(F.lower(extension).isin(*LINEAR_EXTENSIONS), F.lit(False)) | F.coalesce(container.isin(*LINEAR_CONTAINERS), F.lit(False))


def _icon(extension: Column, at: int) -> Column:
    found = F.lit(GENERIC_ICON[at])
    for row in ICONS:
        found = F.when(F.lower(extension).isin(row[2].split()), row[at]).otherwise(found)
    return found


def icon_category(extension: Column) -> Column:
    return _icon(extension, 0)


def icon_color(extension: Column) -> Column:
    return _icon(extension, 1)


def url_encode(path: Column) -> Column:
    """Percent-encoding in which letters, digits and -._~ stay."""
    coded = F.url_encode(path)
    for had, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(had), F.lit(wanted))
    return coded


def stream_url(path: Column, category: Column, playback: Column, quality: Column) -> Column:
    """The address of a file's stream: audio or video, through the transcoder unless playback is Native. Null quality is `preview`."""
    kind = F.when(category == "Audio", "audio").otherwise("video")
    native = F.coalesce(playback == "Native", F.lit(False))
    plain = F.concat(kind, F.lit("://localhost/"), url_encode(path))
    coded = F.concat(kind, F.lit("-stream://localhost/"), url_encode(path), F.lit("?quality="), F.coalesce(quality, F.lit("preview")))
    return F.when(native, plain).otherwise(coded)


def segment_of(path: Column) -> Column:
    """struct(file, segment) of a segment address `<encoded path>/<number>[.ts]`; null if it isn't one."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    decoded = F.coalesce(decoded, path)
    number = F.regexp_extract(decoded, r"/(\d+)(\.ts)*$", 1)
    return F.when(number != "", F.struct(F.regexp_extract(decoded, r"(?s)^(.*)/[^/]*$", 1).alias("file"), number.try_cast("long").alias("segment")))


def segments(duration: Column, seconds: float = SEGMENT_SECONDS) -> Column:
    """array<struct<index, start, length>>: a duration cut into segments, the last with what is left. Null or none: empty."""
    n = F.ceil(F.coalesce(duration, F.lit(0.0)) / seconds).cast("int")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.struct(i.alias("index"), (i * F.lit(seconds)).alias("start"), F.least(duration - i * F.lit(seconds), F.lit(seconds)).alias("length")))


def playlist(path: Column, duration: Column, quality: Column, seconds: float = SEGMENT_SECONDS) -> Column:
    """The text of an on-demand playlist that names every segment."""
    lines = F.transform(segments(duration, seconds), lambda s: F.concat(F.format_string("#EXTINF:%.3f,\n", s["length"]), F.lit("/segment/"), path, F.lit("/"), s["index"].cast("string"), F.lit(".ts?quality="), quality, F.lit("\n")))
    head = f"#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:{-int(-seconds // 1)}\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:VOD\n"
    return F.concat(F.lit(head), F.array_join(lines, ""), F.lit("#EXT-X-ENDLIST\n"))


def cache_key(*parts: Column) -> Column:
    """16 hex digits by which a derived file is kept; other inputs (path, quality, time in whole seconds) give other keys."""
    return F.lower(F.lpad(F.hex(F.xxhash64(*parts)), 16, "0"))


def thumbnail_name(path: Column) -> Column:
    """The file that an image's thumbnail is kept in: a digest of its path, so the same for every scan; null for none."""
    return F.when(path.isNotNull(), F.concat(cache_key(path), F.lit(".webp")))


def waveform(samples: Column, points: int = WAVEFORM_POINTS) -> Column:
    """Peaks of at most `points` chunks of `samples` (array of floats), as shares of the highest; silence stays zero.

    A chunk has size // points samples, and what is left over after `points` chunks is not looked at.
    """
    loud = F.transform(samples, lambda x: F.abs(x))
    size = F.size(samples)
    step = F.floor(size / points).cast("int")
    starts = F.sequence(F.lit(0), F.lit(points - 1))
    peaks = F.when(size <= points, loud).otherwise(F.transform(starts, lambda k: F.array_max(F.slice(loud, k * step + 1, F.greatest(step, F.lit(1))))))
    top = F.array_max(peaks)
    return F.when(top > 0, F.transform(peaks, lambda x: x / top)).otherwise(peaks)
