"""EXIF tags of image files as a map column."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tag number and name.
TAGS = {
    0x010E: "Image Description",
    0x010F: "Manufacturer",
    0x0110: "Model",
    0x0112: "Orientation",
    0x011A: "X Resolution",
    0x011B: "Y Resolution",
    0x0128: "Resolution Unit",
    0x0131: "Software",
    0x0132: "Image date",
    0x013B: "Artist",
    0x8298: "Copyright",
    0x829A: "Exposure time",
    0x829D: "Aperture",
    0x8822: "Exposure program",
    0x8827: "ISO speed ratings",
    0x9000: "EXIF version",
    0x9003: "Date of original image",
    0x9004: "Date of image digitalization",
    0x9204: "Exposure bias value",
    0x9207: "Metering mode",
    0x9209: "Flash",
    0x920A: "Focal length",
    0xA002: "Pixel X dimension",
    0xA003: "Pixel Y dimension",
    0xA434: "Lens model",
}
#: Tags that lead to further directories.
SUBDIRECTORIES = (0x8769, 0x8825)
#: Type number: struct code and size. Pairs are fractions.
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("B", 1), 9: ("i", 4), 10: ("ii", 8)}
#: Most directories of a file, so that loops end.
DIRECTORIES = 16


def _tiff(data: bytes) -> bytes:
    """The TIFF part of a file: the file itself, or what a JPEG's first APP1 segment holds; empty if there is none."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def read_exif(data: bytes | None) -> dict[str, str]:
    """The known tags of a JPEG or TIFF file as text. Blank values are left out; what can't be read has none."""
    tiff = _tiff(data or b"")
    order = "<" if tiff[:2] == b"II" else ">"
    found: dict[str, str] = {}
    try:
        todo = [struct.unpack_from(f"{order}I", tiff, 4)[0]] if tiff else []
        for _ in range(DIRECTORIES):
            if not todo:
                break
            at = todo.pop(0)
            for k in range(struct.unpack_from(f"{order}H", tiff, at)[0]):
                tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * k)
                code, size = KINDS.get(kind, ("", 0))
                place = at + 10 + 12 * k
                if size * n > 4:
                    place = struct.unpack_from(f"{order}I", tiff, place)[0]
                if tag in SUBDIRECTORIES:
                    todo.append(struct.unpack_from(f"{order}I", tiff, at + 10 + 12 * k)[0])
                elif tag in TAGS and code and size * n <= len(tiff):
                    values = struct.unpack_from(f"{order}{n}s" if code == "s" else f"{order}{code * n}", tiff, place)
                    if code == "s":
                        text = values[0].split(b"\0")[0].decode("utf-8", "replace")
                    elif len(code) == 2:
                        text = ", ".join(f"{a}/{b}" for a, b in zip(values[::2], values[1::2], strict=True))
                    else:
                        text = ", ".join(map(str, values))
                    if text.strip():
                        found[TAGS[tag]] = text
    except struct.error:
        return found
    return found


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def exif(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """read_exif() of a column of files' content."""
    for batch in batches:
        yield batch.map(read_exif)
