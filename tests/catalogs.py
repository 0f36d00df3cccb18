"""A small catalog with a row for every rule."""

from __future__ import annotations

from datetime import datetime

from vitrine.sources.catalog import SCHEMAS, Catalog

T = datetime

FOLDERS = [
    (1, None, "/a", "a", True),
    (2, 1, "/a/b", "b", False),
    (3, 1, "/a/bc", "bc", False),
    (4, 2, "/a/b/c", "c", False),
    (5, 4, "/a/b/c/é", "é", False),
    (6, 99, "/orphan", "orphan", False),
    (7, None, "/A/empty", "empty", False),
    (8, 9, "/loop/x", "x", False),
    (9, 8, "/loop/y", "y", False),
]
# id, folder, filename, width, height, size, format, rating, notes, created, modified, added
IMAGES = [
    (1, 1, "Dragon.png", 10, 20, 100, "png", 0, "a DRAGON sleeps", T(2024, 1, 1), T(2024, 1, 5), T(2024, 1, 5, 12)),
    (2, 2, "dragÓn_a.jpg", None, 20, 200, "jpg", 1, None, T(2024, 1, 1, 0, 0, 0, 500_000), T(2024, 1, 5, 10), T(2024, 1, 6)),
    (3, 2, "a.tar.gz", 5, None, None, None, 2, "100% sure", T(2024, 1, 2), T(2024, 1, 6), None),
    (4, 4, "a", 1, 1, 1, "JPG", 3, "", T(2024, 1, 2), T(2024, 1, 7), T(2024, 1, 5, 23, 59, 59)),
    (5, 5, "ba.png", 4000, 3000, 2**40, "jpeg", 4, "x_y\\z \"q\"", T(2024, 1, 3), T(2024, 2, 1), T(2024, 1, 4)),
    (6, 6, "B.png", 7, 7, 100, "jpe", 5, "dragó", T(2024, 1, 1), T(2024, 1, 5), T(2024, 1, 5)),
    (7, 3, "A.PNG", 7, 7, 1, "png", 1, "tail a.", T(2024, 1, 9), T(2024, 1, 9, 1, 2, 3, 4), T(2024, 1, 9)),
    (8, 8, "loop.webp", 1, 2, 3, "webp", 0, "no", T(2024, 1, 9), T(2024, 1, 9), T(2024, 1, 9)),
]
TAGS = [(1, "animals", None, None, 0), (2, "Dragons", 1, "#f00", 200), (3, "birds", 1, None, 100), (4, "places", None, None, 0), (5, "lost", 77, None, 3)]
LINKS = [(1, 1), (1, 2), (2, 2), (4, 1), (4, 2), (4, 3), (6, 3)]


def small_catalog(spark) -> Catalog:
    paths = {f[0]: f[2] for f in FOLDERS}
    images = [(i, f, f"{paths[f]}/{n}", n, w, h, s, fmt, r, notes, c, m, a, None if i % 2 else f"t{i}", i % 4, None) for i, f, n, w, h, s, fmt, r, notes, c, m, a in IMAGES]
    rows = {"folders": FOLDERS, "images": images, "tags": TAGS, "image_tags": LINKS}
    return Catalog(spark, {t: spark.createDataFrame(x, SCHEMAS[t]) for t, x in rows.items()})
