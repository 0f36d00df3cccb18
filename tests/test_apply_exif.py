"""Whole batches on a catalog, and EXIF tags."""

from __future__ import annotations

import struct
from datetime import datetime as T

from catalogs import small_catalog
from pyspark.sql import functions as F

from vitrine.operators import stats
from vitrine.sources.exif import exif, read_exif
from vitrine.streaming.apply import apply_batch, finish_removals, rename_folders
from vitrine.streaming.changes import coalesce, pair_untracked, sessions


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_many_folders_are_renamed_at_once(spark):
    c = small_catalog(spark)
    renames = spark.createDataFrame([("/a", "/z"), ("/a/b/c", "/a/b/deep"), ("/none", "/x"), ("/orphan", "/a/bc")], "path string, to_path string")
    done, unknown = rename_folders(c, renames)
    assert rows(unknown, "path") == [("/none",)]
    got = dict(rows(done.folders, "id", "path"))
    # the closest renamed head above a path counts; /orphan was merged into /a/bc first
    assert got == {1: "/z", 2: "/z/b", 3: "/z/bc", 4: "/a/b/deep", 5: "/a/b/deep/é", 7: "/A/empty", 8: "/loop/x", 9: "/loop/y"}
    assert done.images.where("id = 4").first().path == "/a/b/deep/a" and done.images.where("id = 6").first().folder_id == 3
    assert dict(rows(done.folders, "id", "name"))[1] == "z"


def test_a_batch_keeps_catalog_and_counters(spark):
    c = small_catalog(spark).materialized()
    events = [
        (1, "remove", "/a/Dragon.png", None, None, False),
        (2, "upsert", "/new/dir", None, None, True),
        (3, "upsert", "/new/n.png", None, None, False),
        (4, "rename", "/a/b/c", "/a/b/cc", None, True),
        (5, "rename", "/orphan/B.png", "/a/bc/B.png", None, False),
        (6, "rename", "/a/b/dragÓn_a.jpg", "/a/bc/d.jpg", None, False),  # has no width, so it is added instead
        (7, "upsert", "/loop/x/loop.webp", None, None, False),
    ]
    schema = "root string, seq long, kind string, path string, to_path string, tracker long, is_dir boolean, size long, created_at timestamp"
    feed = spark.createDataFrame([("/r", s, k, p, t, tr, d, s, T(2024, 1, 1)) for s, k, p, t, tr, d in events], schema)
    day = T(2024, 5, 5)
    found = [("/new/n.png", "n.png", 1, 1, 77, "png", day, day), ("/a/bc/d.jpg", "d.jpg", 2, 2, 200, "jpg", day, T(2024, 1, 1, 0, 0, 0, 500_000)), ("/loop/x/loop.webp", "loop.webp", 1, 2, 30, "webp", day, day)]
    files = spark.createDataFrame(found, "path string, filename string, width int, height int, size long, format string, modified_at timestamp, created_at timestamp")
    on_disk = c.images.where("id NOT IN (1, 2)").select("path").unionByName(files.select("path"))
    done = apply_batch(c, pair_untracked(coalesce(feed), c.images), files, on_disk)
    assert done.refresh and rows(done.changes, "op", "image_id", "old_folder_id") == [("added", 9, None), ("removed", 1, None), ("updated", 2, 2), ("updated", 6, 6), ("updated", 8, None)]
    folders = {r.path: r for r in done.catalog.folders.collect()}
    assert folders["/a/b/cc"].id == 4 and {"/new", "/new/dir"} <= set(folders)
    images = {r.id: r for r in done.catalog.images.collect()}
    assert images[2].path == "/a/bc/d.jpg" and images[2].folder_id == 3 and images[6].path == "/a/bc/B.png" and images[8].size == 30 and 1 in images
    assert images[4].path == "/a/b/cc/a" and images[9].folder_id == folders["/new"].id

    # once the grace is over, counters that followed the changes agree with a recount
    after = finish_removals(done.catalog, done.pending, on_disk).materialized()
    assert 1 not in {r.id for r in after.images.collect()}
    told = stats.apply_deltas(stats.counters(c), stats.counter_deltas(done.changes, done.catalog.folders)).where("count > 0")
    assert rows(told, "kind", "key", "count") == rows(stats.counters(after).where("count > 0"), "kind", "key", "count")


def test_no_renamed_folder_moves_nothing(spark):
    c = small_catalog(spark)
    done, unknown = rename_folders(c, spark.createDataFrame([("/nowhere", "/b"), ("/a/b", "/a/b")], "path string, to_path string"))
    assert done is c and [tuple(r) for r in unknown.select("path", "to_path").collect()] == [("/nowhere", "/b")]


def test_removed_folders_go_with_all_below(spark):
    c = small_catalog(spark)
    due = spark.createDataFrame([("/a/b",), ("/a/Dragon.png",), ("/A/empty",)], "path string")
    after = finish_removals(c, due, spark.createDataFrame([("/A/empty",)], "path string"))
    assert rows(after.folders, "id") == [(1,), (3,), (6,), (7,), (8,), (9,)] and rows(after.images, "id") == [(6,), (7,), (8,)]


def test_nothing_happens(spark):
    c = small_catalog(spark)
    none = spark.createDataFrame([], "root string, op string, path string, to_path string, is_dir boolean, size long, created_at timestamp")
    files = c.images.where("false")
    done = apply_batch(c, none, files, c.images)
    assert not done.refresh and done.changes.count() == 0 and done.catalog.images.count() == 8


def test_sessions(spark):
    ts = [("a", T(2024, 1, 1, 0, 0, s)) for s in (0, 20, 50)] + [("b", T(2024, 1, 1)), ("b", T(2024, 1, 1, 0, 1, 1))]
    got = sessions(spark.createDataFrame(ts, "k string, ts timestamp"), "k", idle="60 seconds")
    assert rows(got, "k", "n") == [("a", 3), ("b", 1), ("b", 1)]


def photo(order: str = "<") -> bytes:
    """A JPEG with two directories."""
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8)
    entries = [(0x010F, 2, 6, None), (0x0110, 2, 3, b"M1\0\0"), (0x0112, 3, 1, struct.pack(f"{order}HH", 6, 0)), (0x8769, 4, 1, struct.pack(f"{order}I", 100)), (0x0131, 2, 3, b"  \0\0"), (0xFFFF, 3, 1, b"\0\0\0\0")]
    body = struct.pack(f"{order}H", len(entries))
    for tag, kind, n, value in entries:
        body += struct.pack(f"{order}HHI", tag, kind, n) + (value if value is not None else struct.pack(f"{order}I", 90))
    tiff += body + b"\0\0\0\0"
    tiff = tiff.ljust(90, b"\0") + b"Canon\0"
    tiff = tiff.ljust(100, b"\0") + struct.pack(f"{order}H", 1) + struct.pack(f"{order}HHI", 0x829A, 5, 1) + struct.pack(f"{order}I", 120) + b"\0\0\0\0"
    tiff = tiff.ljust(120, b"\0") + struct.pack(f"{order}II", 1, 250)
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


def test_exif(spark):
    want = {"Manufacturer": "Canon", "Model": "M1", "Orientation": "6", "Exposure time": "1/250"}
    assert read_exif(photo("<")) == read_exif(photo(">")) == want
    for bad in (None, b"", b"\xff\xd8", photo()[:60], b"II*\0\xff\xff\xff\xff", b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", 1) + struct.pack(">HHI", 0x8769, 4, 1) + struct.pack(">I", 8)):
        assert set(read_exif(bad)) <= set(want)
    df = spark.createDataFrame([(1, photo()), (2, b"x"), (3, None)], "id long, content binary")
    assert {r.id: r.m for r in df.select("id", exif("content").alias("m")).collect()} == {1: want, 2: {}, 3: {}}
    assert df.where("false").select(exif(F.col("content"))).count() == 0
