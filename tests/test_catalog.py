"""Hierarchies, statistics, writes, ingestion and sources."""

from __future__ import annotations

import os
from datetime import datetime as T

import pytest
from catalogs import FOLDERS, IMAGES, LINKS, TAGS, small_catalog
from pyspark.sql import functions as F

from vitrine.functions import paths
from vitrine.operators import hierarchy, ingest, stats, writes
from vitrine.operators.numbering import numbered
from vitrine.sources import catalog as catalogs
from vitrine.sources import files, formats
from vitrine.sources.shared import shared_path


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark).materialized()


def rows(df, *columns) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# trees


def brute_closure(nodes) -> set[tuple[int, int, int]]:
    parent = {i: p for i, p in nodes}
    out = {}
    for i in parent:
        at, d = i, 0
        while at in parent and (i, at) not in out:
            out[(i, at)] = d
            at, d = parent[at], d + 1
    return {(i, a, d) for (i, a), d in out.items()}


def test_closure(spark, catalog):
    got = {tuple(r) for r in hierarchy.closure(catalog.folders).collect()}
    assert got == brute_closure([(f[0], f[1]) for f in FOLDERS])
    chain = [(k, k - 1 if k else None) for k in range(51)]
    df = spark.createDataFrame(chain, "id long, parent_id long")
    assert {tuple(r) for r in hierarchy.closure(df).collect()} == brute_closure(chain)
    assert hierarchy.closure(df.where("false")).count() == 0
    assert hierarchy.subtree(df, 0).count() == 51 and hierarchy.subtree(df, 0, depth=10).count() == 11
    assert sorted(r.id for r in hierarchy.subtree(catalog.folders, 8).collect()) == [8, 9]
    assert hierarchy.subtree(catalog.folders, 1234).count() == 0


def test_listings(catalog):
    tree = [tuple(r) for r in hierarchy.tree_rows(catalog.tags, ["order_index", "name"]).orderBy("place").select("id", "depth").collect()]
    assert tree == [(1, 0), (3, 1), (2, 1), (4, 0), (5, 0)]
    assert rows(hierarchy.roots(catalog.folders), "id") == [(1,), (7,)]
    assert rows(hierarchy.under_path(catalog.folders, "/a/b/"), "id") == [(2,), (4,), (5,)]
    counts = stats.tag_counts(catalog).withColumnRenamed("tag_id", "id")
    assert rows(hierarchy.forest_of(catalog.tags, counts), "id", "parent_id", "count") == sorted([(1, None, 2), (2, 1, 3), (3, 1, 2), (4, None, 0), (5, None, 0)], key=str)


def test_paths(spark):
    asked = ["/a/b", "/a/b///", "/", "", "///", "/x", "x", "x/y.TAR.Gz", "/a/.hidden", "/a/n.", None]
    p = F.col("p")
    df = spark.createDataFrame([(k, a) for k, a in enumerate(asked)], "k int, p string")
    got = df.select("k", paths.normalize(p).alias("n"), paths.parent(p).alias("up"), paths.basename(p).alias("b"), paths.extension(p).alias("e"), paths.ancestors(p).alias("all")).orderBy("k").collect()
    assert [r.n for r in got] == ["/a/b", "/a/b", "/", "/", "/", "/x", "x", "x/y.TAR.Gz", "/a/.hidden", "/a/n.", None]
    assert [r.up for r in got] == ["/a", "/a", None, None, None, "/", None, "x", "/a", "/a", None]
    assert [r.e for r in got] == [None, None, None, None, None, None, None, "gz", None, None, None]
    assert [r["all"] for r in got][:8] == [["/a", "/a/b"], ["/a", "/a/b"], [], [], [], ["/x"], ["x"], ["x", "x/y.TAR.Gz"]]
    moved = df.select(paths.replace_prefix(p, "/a", "/zz/é").alias("m")).collect()
    assert [r.m for r in moved][:3] == ["/zz/é/b", "/zz/é/b///", "/"]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), "id").repartition(7)
    got = numbered(df, ["v"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1000)) and [r.v for r in got] == sorted(r.v for r in got)
    assert numbered(df.where("false"), ["v"]).count() == 0


# statistics


def test_counts(catalog):
    t = stats.totals(catalog).first()
    assert (t.total_images, t.untagged_images) == (8, 4)
    assert rows(stats.tag_counts(catalog), "tag_id", "count") == [(1, 2), (2, 3), (3, 2)]
    own = {f: sum(i[1] == f for i in IMAGES) for f in range(1, 10)}
    assert rows(stats.folder_counts(catalog), "folder_id", "count") == [(f, n) for f, n in own.items() if n]
    want = {}
    for i, a, _ in brute_closure([(f[0], f[1]) for f in FOLDERS]):
        want[a] = want.get(a, 0) + own[i]
    assert dict(rows(stats.folder_counts_recursive(catalog), "folder_id", "count")) == want


def test_counters_follow_changes(spark, catalog):
    """Deltas come to what a recount gives, as long as what is added has no tags."""
    gone, moved = [4, 6], [2]
    links = {i: [t for x, t in LINKS if x == i] for i in gone}
    folder = {i[0]: i[1] for i in IMAGES}
    changes = [("removed", i, folder[i], None, links[i]) for i in gone] + [("added", 100, 5, None, None), ("added", 101, 2, None, [])]
    changes += [("updated", i, 3, folder[i], None) for i in moved] + [("updated", 1, 1, 1, None), ("updated", 1, 1, None, None)]
    deltas = stats.counter_deltas(spark.createDataFrame(changes, stats.CHANGES), catalog.folders)
    got = stats.apply_deltas(stats.counters(catalog), deltas).where("count > 0 OR kind IN ('total', 'untagged')")
    images = catalog.images.where(~F.col("id").isin(gone)).withColumn("folder_id", F.when(F.col("id").isin(moved), 3).otherwise(F.col("folder_id")))
    new = spark.createDataFrame([(100, 5), (101, 2)], "id long, folder_id long")
    after = catalog.put(images=images.select("id", "folder_id").unionByName(new), image_tags=catalog.image_tags.where(~F.col("image_id").isin(gone)))
    assert rows(got, "kind", "key", "count") == rows(stats.counters(after).where("count > 0 OR kind IN ('total', 'untagged')"), "kind", "key", "count")


def test_counters_stop_at_zero(spark, catalog):
    changes = spark.createDataFrame([("removed", 900 + k, 7, None, [5]) for k in range(20)] + [("added", 1, 7, None, None)], stats.CHANGES)
    got = {(r.kind, r.key): r["count"] for r in stats.apply_deltas(stats.counters(catalog), stats.counter_deltas(changes, catalog.folders)).collect()}
    assert got[("total", None)] == 8 - 20 + 1 and got[("tag", 5)] == 0 and got[("folder", 7)] == 1 and got[("folder_recursive", 7)] == 1


# writes


def test_upsert(spark, catalog):
    day = T(2024, 3, 1)
    given = [
        ("/a/Dragon.png", 2, "Dragon.png", 11, 21, 101, "png", day, T(2030, 1, 1)),
        ("/new/moved.png", 3, "moved.png", 9, 9, 1, "png", day, T(2024, 1, 9)),  # as A.PNG, whose path is gone
        ("/new/again.png", 3, "again.png", 9, 9, 1, "png", day, T(2024, 1, 9)),
        ("/new/b.png", 3, "b.png", 9, 9, 100, "png", day, T(2024, 1, 1)),  # as B.png, which is still there
        ("/new/twice.png", 3, "old", 9, 9, 5, "png", T(2024, 1, 1), day),
        ("/new/twice.png", 3, "new", 9, 9, 6, "png", day, day),
    ]
    df = spark.createDataFrame(given, "path string, folder_id long, filename string, width int, height int, size long, format string, modified_at timestamp, created_at timestamp")
    on_disk = catalog.images.where("id <> 7").select("path")
    after, told = writes.upsert_images(catalog, df, on_disk)
    by = {r.path: r for r in told.collect()}
    assert (by["/a/Dragon.png"].id, by["/a/Dragon.png"].old_folder_id, by["/a/Dragon.png"].is_new) == (1, 1, False)
    one = {p: by[p] for p in ("/new/again.png", "/new/moved.png")}
    assert [r.is_new for _, r in sorted(one.items())] == [False, True] and one["/new/again.png"].id == 7 and one["/new/again.png"].old_folder_id == 3
    news = sorted(r.id for r in by.values() if r.is_new)
    assert news == [9, 10, 11] and len(by) == 5
    images = {r.id: r for r in after.images.collect()}
    assert len(images) == 11 and images[1].size == 101 and images[1].notes == "a DRAGON sleeps" and images[1].created_at == T(2024, 1, 1) and images[1].folder_id == 2
    assert images[7].path == "/new/again.png" and images[7].width == 7 and images[7].rating == 1
    assert images[by["/new/twice.png"].id].filename == "new" and images[by["/new/twice.png"].id].rating == 0
    assert after.images.columns == catalog.images.columns


def test_image_writes(spark, catalog):
    c = writes.set_notes(writes.set_rating(catalog, 1, 9), 2, None)
    assert c.images.where("id = 1").first().rating == 9
    c = writes.thumbnail_failed(writes.set_thumbnail(c, 3, "t"), 3, "why")
    r = c.images.where("id = 3").first()
    assert (r.thumbnail_path, r.thumbnail_attempts, r.thumbnail_last_error) == ("t", 4, "why")
    after, gone = writes.delete_images(catalog, catalog.images.where("id IN (4, 5)"))
    assert rows(gone, "id", "folder_id", "tag_ids") == [(4, 4, [1, 2, 3]), (5, 5, [])]
    assert after.images.count() == 6 and after.image_tags.where("image_id = 4").count() == 0
    renames = spark.createDataFrame([("/a/Dragon.png", "/x/d.png", "d.png", 3), ("/a/b/dragÓn_a.jpg", "/x/e.jpg", "e.jpg", 3), ("/none", "/y", "y", 3)], "from string, to string, filename string, folder_id long")
    after, told = writes.rename_images(catalog, renames, F.lit(T(2025, 1, 1)))
    assert rows(told, "to", "id", "old_folder_id") == [("/x/d.png", 1, 1)]  # the other has no width
    r = after.images.where("id = 1").first()
    assert (r.path, r.filename, r.folder_id, r.modified_at) == ("/x/d.png", "d.png", 3, T(2025, 1, 1))


def test_folder_writes(spark, catalog):
    asked = spark.createDataFrame([("/a/b/n/m/",), ("/z",), ("rel/x",), ("/a/b",)], "path string")
    new = writes.ensure_folders(catalog, asked).folders
    by = {r.path: r for r in new.collect()}
    assert set(by) - {f[2] for f in FOLDERS} == {"/a/b/n", "/a/b/n/m", "/z", "rel", "rel/x"}
    assert by["/a/b/n"].parent_id == 2 and by["/a/b/n/m"].parent_id == by["/a/b/n"].id and by["/z"].parent_id is None and by["rel/x"].parent_id == by["rel"].id
    assert len({r.id for r in by.values()}) == len(by)
    assert writes.ensure_folders(catalog, asked.where("false")).folders.count() == len(FOLDERS)

    c = writes.upsert_folder(catalog, "/a/", "a", parent_id=7)  # a root is never demoted
    assert c.folders.where("id = 1").first().parent_id is None
    c = writes.upsert_folder(catalog, "/A/B", "b", is_root=True)  # found but for case
    r = c.folders.where("id = 2").first()
    assert r.is_root and r.parent_id is None
    c = writes.upsert_folder(catalog, "/q", "q", parent_id=3)
    assert c.folders.where("path = '/q'").first().parent_id == 3

    c = writes.rename_folder(catalog, "/a/b", "/a/é")
    assert rows(c.folders.where("id IN (2, 3, 4)"), "id", "path", "name") == [(2, "/a/é", "é"), (3, "/a/bc", "bc"), (4, "/a/é/c", "c")]
    assert c.images.where("id = 3").first().path == "/a/é/a.tar.gz" and c.images.where("id = 7").first().path == "/a/bc/A.PNG"
    c = writes.rename_folder(catalog, "/a/b", "/a/bc")  # is there: it takes over
    assert c.folders.where("id = 2").count() == 0 and c.folders.where("id = 4").first().parent_id == 3 and c.images.where("id = 2").first().folder_id == 3
    assert writes.rename_folder(catalog, "/none", "/x").folders.count() == len(FOLDERS)

    c = writes.delete_folder(catalog, 2)
    assert rows(c.folders, "id") == [(1,), (3,), (6,), (7,), (8,), (9,)] and rows(c.images, "id") == [(1,), (6,), (7,), (8,)]
    assert rows(c.image_tags, "image_id", "tag_id") == [(1, 1), (1, 2), (6, 3)]

    c = writes.add_location(catalog, "/orphan/deep/er")
    assert c.folders.where("path = '/orphan/deep/er'").first().parent_id == 6
    roots = catalog.put(folders=writes.update(catalog.folders, F.col("id") == 6, {"is_root": True}))
    c = writes.add_location(roots, "/")
    top = c.folders.where("path = '/'").first()
    assert top.is_root and c.folders.where("id = 6").first().parent_id == top.id and c.folders.where("id = 1").first().parent_id == top.id
    near = hierarchy.nearest_ancestor(spark.createDataFrame([("/a/b/c/x/y",), ("/a",), ("/u/v",)], "path string"), catalog.folders)
    assert rows(near, "path", "parent_id") == [("/a", None), ("/a/b/c/x/y", 4), ("/u/v", None)]


def test_tag_writes(spark, catalog):
    c = writes.create_tag(catalog, "new", 4, "#0f0")
    assert c.tags.where("name = 'new'").first().id == 6
    with pytest.raises(ValueError):
        writes.create_tag(catalog, "birds")
    c = writes.update_tag(catalog, 2, name="d", parent_id=0)
    r = c.tags.where("id = 2").first()
    assert (r.name, r.parent_id, r.color, r.order_index) == ("d", None, "#f00", 200) and writes.update_tag(catalog, 2) is catalog
    c = writes.delete_tag(catalog, 1)
    assert c.tags.where("id = 2").first().parent_id is None and c.image_tags.where("tag_id = 1").count() == 0 and c.tags.count() == 4
    assert rows(writes.delete_tag(catalog, 1, with_children=True).tags, "id") == [(4,), (5,)]
    c = writes.assign_tags(catalog, spark.createDataFrame([(1,), (1,), (3,)], "id long"), [2, 4, 4])
    assert rows(c.image_tags, "image_id", "tag_id") == sorted({*LINKS, (1, 4), (3, 2), (3, 4)}, key=str)
    assert writes.assign_tags(catalog, catalog.images.where("false"), [2]).image_tags.count() == len(LINKS)
    assert writes.unassign_tag(catalog, 1, 2).image_tags.count() == len(LINKS) - 1
    held = catalog.image_tags
    assert rows(writes.tag_changes(held.where("image_id = 1"), held.where("image_id = 6")), "op", "tag_id") == [("add", 3), ("remove", 1), ("remove", 2)]


@pytest.mark.parametrize(
    ("tag", "target", "position", "want"),
    [
        (4, 2, "before", {3: (1, 0), 4: (1, 100), 2: (1, 200)}),
        (4, 2, "after", {3: (1, 0), 2: (1, 100), 4: (1, 200)}),
        (4, 1, "inside", {3: (1, 0), 2: (1, 100), 4: (1, 200)}),
        (2, 3, "before", {2: (1, 0), 3: (1, 100)}),
        (2, None, "inside", {1: (None, 0), 4: (None, 100), 2: (None, 200)}),
        (2, 4, "before", {1: (None, 0), 2: (None, 100), 4: (None, 200)}),
        (99, 4, "before", {}),
    ],
)
def test_move_tag(catalog, tag, target, position, want):
    got = {r.id: (r.parent_id, r.order_index) for r in writes.move_tag(catalog, tag, target, position).tags.collect()}
    had = {t[0]: (t[2], t[4]) for t in TAGS}
    assert got == had | want


def test_names_searches_settings(spark, catalog):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert writes.free_name(names("x", "New Tag (2)")) == "New Tag"
    assert writes.free_name(names("New Tag", "New Tag (1)", "New Tag (3)", "New Tag x")) == "New Tag (2)"
    c = writes.save_search(catalog, "s", '{"a":1}')
    c = writes.save_search(c, "t", '{"a":2}')
    assert [r.name for r in writes.active_search(c, '{"a":2}').collect()] == ["t"] and writes.active_search(c, '{"a": 2}').count() == 0
    c = writes.update_search(c, 1, "u", "{}")
    assert rows(writes.delete_search(c, 2).smart_folders, "id", "name", "query_json") == [(1, "u", "{}")]
    c = writes.set_setting(writes.set_setting(catalog, "k", {"x": [1]}), "k", {"x": [2]})
    assert writes.get_setting(c, "k") == {"x": [2]} and writes.get_setting(c, "none") is None
    assert writes.get_setting(catalog.put(app_settings=spark.createDataFrame([("b", "{")], catalogs.SCHEMAS["app_settings"])), "b") is None


def test_violations(spark, catalog):
    found = rows(catalog.violations(), "rule", "key", "n")
    assert found == [("folders.parent_id", "99", 1)]
    twice = catalog.put(image_tags=catalog.image_tags.unionByName(catalog.image_tags.where("image_id = 6")))
    assert ("image_tags", "6/3", 2) in rows(twice.violations(), "rule", "key", "n")


# ingestion and sources


def test_diff_and_moves(spark, catalog):
    disk = [("/a/Dragon.png", 100, T(2024, 1, 5, 0, 0, 0, 999_999)), ("/a/b/dragÓn_a.jpg", 200, T(2024, 1, 5, 10, 0, 1)), ("/a/b/a.tar.gz", 5, T(2024, 1, 6)), ("/n", 1, T(2024, 1, 1))]
    states = ingest.snapshot_diff(spark.createDataFrame(disk, "path string, size long, modified_at timestamp"), catalog.images)
    assert dict(rows(states, "path", "state")) == {"/a/Dragon.png": "clean", "/a/b/dragÓn_a.jpg": "changed", "/a/b/a.tar.gz": "changed", "/n": "new"}
    assert tuple(ingest.diff_totals(states).first()) == (4, 3, 1)
    gone = ingest.orphaned_folders(catalog.folders, spark.createDataFrame([("/a/",), ("/a/b/c",)], "path string"), "/a")
    assert rows(gone, "id") == [(2,), (3,), (5,)]


def test_registry(spark):
    formats_df = formats.registry(spark)
    everything = formats.registry_rows()
    assert len(everything) == 127 and len({e for r in everything for e in r[2]}) == 171
    kinds = {}
    for r in everything:
        kinds.setdefault(r[4], []).append(len(r[2]))
    assert {k: (len(x), sum(x)) for k, x in kinds.items()} == {"Image": (41, 58), "Video": (23, 36), "Audio": (22, 27), "Project": (20, 25), "Model3D": (15, 19), "Font": (6, 6)}
    png, tiff = bytes.fromhex("89504E470D0A1A0A"), bytes.fromhex("49492A00")
    rows_ = [(1, "/a.jpg", png), (2, "/a.nef", tiff), (3, "/a", tiff), (4, "/a.xyz", b"??"), (5, "/a.OGG", b""), (6, "/a", None), (7, "/x.txt", bytes.fromhex("25504446"))]
    got = formats.detect(spark.createDataFrame(rows_, "id long, path string, content binary"), formats_df)
    assert {r.id: r.format_name for r in got.collect()} == {1: "PNG Image", 2: "Nikon Raw", 3: "TIFF Image", 4: None, 5: "Ogg Audio", 6: None, 7: "Adobe Illustrator"}
    asked = spark.createDataFrame([("a.PNG",), ("b.txt",), ("c.kra~",), ("noext",)], "path string")
    assert rows(formats.supported(asked, formats_df), "path") == [("a.PNG",), ("c.kra~",)]


def test_scan(spark, tmp_path, catalog):
    (tmp_path / "d e").mkdir()
    (tmp_path / "d e" / "a.png").write_bytes(bytes.fromhex("89504E470D0A1A0A0000000D49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big"))
    (tmp_path / "b.GIF").write_bytes(b"GIF89a" + (33).to_bytes(2, "little") + (44).to_bytes(2, "little"))
    (tmp_path / "c.bmp").write_bytes(b"BM" + bytes(16) + (5).to_bytes(4, "little") + (6).to_bytes(4, "little"))
    (tmp_path / "skip.txt").write_text("x")
    (tmp_path / "f.jpg").write_bytes(b"\xff\xd8\xff")
    found = files.header_dimensions(files.scan_directory(spark, f"file://{tmp_path}", with_head=True))
    got = {r.filename: (r.format, r.size, r.width, r.height) for r in found.collect()}
    assert got == {"a.png": ("png", 24, 640, 480), "b.GIF": ("gif", 10, 33, 44), "c.bmp": ("bmp", 26, 5, 6), "f.jpg": ("jpg", 3, None, None)}
    plain = files.scan_directory(spark, str(tmp_path))
    assert "head" not in plain.columns and {r.folder for r in plain.collect()} == {str(tmp_path), f"{tmp_path}/d e"}
    assert tuple(files.cache_usage(plain).first()) == (4, 63)
    os.utime(tmp_path / "c.bmp", (0, 0))
    assert [r.filename for r in files.expired(files.scan_directory(spark, str(tmp_path)), "2024-01-01 00:00:00").collect()] == ["c.bmp"]


def test_save_and_load(spark, catalog):
    path = shared_path(spark, "c")
    again = catalog.save(path)
    assert rows(again.images, "id", "notes") == rows(catalog.images, "id", "notes") and again.app_settings.count() == 0
    with pytest.raises(AttributeError):
        catalog.nothing
