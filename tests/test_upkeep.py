"""An index of trigrams, state between triggers, feeds, quarantine, merges, counters, pages and layouts, with the cases that the queries don't have."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from catalogs import small_catalog
from pyspark.sql import functions as F

from vitrine import upkeep
from vitrine.functions import media
from vitrine.functions.text import trigram_contains
from vitrine.operators import hierarchy, intervals, layout, stats, writes
from vitrine.plans import search
from vitrine.plans.search import LibraryQuery
from vitrine.sources import files, shared
from vitrine.sources.shared import materialize, shared_path
from vitrine.sources.trigrams import TrigramIndex, grams_of, pattern_grams
from vitrine.streaming.apply import rename_folders
from vitrine.streaming.ledger import Ledger, Progress, feed
from vitrine.streaming.waits import final_removals, keyed_state, met_halves

T0 = datetime(2024, 1, 1)
TEXTS = ["The green bottle", "THE GREEN wall", None, "", "ab", "ÀÉÎ naïve café", "😀😀 faces", "a\nb c", "greener " * 3000, "İstanbul", "100% sure_thing"]


def matches(spark, rows, pattern):
    df = spark.createDataFrame(rows, "id long, text string")
    return {r["id"] for r in df.where(trigram_contains(F.col("text"), pattern)).collect()}


def test_trigrams_of_texts(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "id long, text string")
    for r in df.select("id", "text", grams_of(F.col("text")).alias("g"), F.lower("text").alias("low")).collect():
        assert sorted(r.g) == sorted({(r.low or "")[k : k + 3] for k in range(len(r.low or "") - 2)})
    assert pattern_grams("Ab") == [] and pattern_grams("GREEN") == ["een", "gre", "ree"]


def test_index_follows_updates_and_compaction(spark):
    rows = {k: t for k, t in enumerate(TEXTS * 3)}
    index = TrigramIndex(spark, shared_path(spark, "t"), slices=8).build(spark.createDataFrame(list(rows.items()), "id long, text string").repartition(3))
    patterns = ["green", "GREEN B", "naïve CAFÉ", "😀 f", "ab", "", "%", "sure_t", "a\nb", "zebra", "er gre"]

    def check(one: TrigramIndex) -> None:
        for p in patterns:
            found = one.contains(p)
            assert {r["id"] for r in found.collect()} == matches(spark, list(rows.items()), p), p

    check(index)
    changed = [(0, "a zebra now", False), (1, None, False), (3, None, True), (99, "new green bottle", False), (8, "green", None)]
    for _ in range(2):  # the same batch twice
        index.update(spark.createDataFrame(changed, "id long, text string, gone boolean"), 1)
    rows.update({0: "a zebra now", 1: None, 99: "new green bottle", 8: "green"})
    del rows[3]
    written = spark.read.parquet(f"{index.path}/postings/generation=1")
    assert {r["id"] for r in written.select("id").distinct().collect()} == {0, 99, 8}
    check(index)
    index.update(spark.createDataFrame([(0, "green again", False)], "id long, text string, gone boolean"), 2)
    rows[0] = "green again"
    check(index)
    small = index.compact(shared_path(spark, "t"))
    check(small)
    assert spark.read.parquet(f"{small.path}/postings").where("id = 0 AND gram = 'zeb'").isEmpty()


def test_texts_are_not_cut_by_patterns(spark):
    plan = spark.range(1).select(grams_of(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "zip_with" not in plan and "ArrowEvalPython" in plan


def test_a_search_reads_few_slices(spark):
    rows = [(k, f"document {k} has words" + (" and a needle" if k in (17, 512) else "")) for k in range(2000)]
    index = TrigramIndex(spark, shared_path(spark, "t")).build(spark.createDataFrame(rows, "id long, text string"))
    found = index.contains("needle")
    assert {r["id"] for r in found.collect()} == {17, 512} and index.candidates("needle").count() == 2
    hit = {r["slice"] for r in index._slice(spark.createDataFrame([(17,), (512,)], "id long")).collect()}
    scans = [p for p in found._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in p and "slice" in p]
    assert scans and all(str(s) in scans[0] for s in hit)
    read = index._rows().where(F.col("slice").isin(*hit)).count()
    assert 2 <= read < 200


def run_stream(spark, parts, schema, build):
    source, out, checkpoint = (shared_path(spark, x) for x in ("in", "out", "cp"))
    with keyed_state(spark):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = build(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def test_removals_wait_over_restarts(spark):
    """Taken back in time, taken back too late, removed twice, gone for good, and a row older than the watermark."""
    schema = "path string, kind string, seq long, at timestamp"
    parts = [
        [("/back", "remove", 1, at(0)), ("/late", "remove", 2, at(0)), ("/twice", "remove", 3, at(0)), ("/gone", "remove", 4, at(0.5)), (None, "remove", 5, at(0))],
        [("/back", "upsert", 6, at(1.5)), ("/twice", "remove", 7, at(1.9)), ("/late", "upsert", 8, at(9)), ("/x", "upsert", 9, at(30))],
        [("/gone", "upsert", 10, at(1)), ("/x", "remove", 11, at(31)), ("/y", "upsert", 12, at(100)), ("/end", "remove", 13, at(101))],
    ]
    told = run_stream(spark, parts, schema, lambda s: final_removals(s, grace_seconds=2, late="5 seconds"))
    assert sorted((r.path, r.seq) for r in told) == [("/gone", 4), ("/late", 2), ("/twice", 7), ("/x", 11)]
    assert {r.path: r.since for r in told}["/gone"] == at(0.5)


def test_halves_meet_over_triggers(spark):
    schema = "root string, kind string, tracker long, path string, at timestamp"
    parts = [
        [("/r", "rename_from", 1, "/a", at(0)), ("/r", "rename_from", 2, "/b", at(0)), ("/r", "rename_from", 3, "/c", at(0)), ("/s", "rename_to", 3, "/d", at(0.1))],
        [("/r", "rename_to", 1, "/a2", at(0.5)), ("/r", "rename_to", 2, "/b2", at(3)), ("/r", "rename_from", 9, "/end", at(60))],
        [("/r", "rename_to", 3, "/c2", at(0.4)), ("/r", "rename_to", 8, "/end", at(70)), ("/r", "rename_from", 10, "/end", at(130)), ("/r", "rename_to", 11, "/end", at(130))],
    ]
    told = run_stream(spark, parts, schema, lambda s: met_halves(s, wait="600 milliseconds", late="2 seconds"))
    got = sorted((r.op, r.path, r.to_path or "") for r in told if r.path != "/end")
    # the half of /c came after the watermark, so it isn't there
    assert got == [("remove", "/b", ""), ("remove", "/c", ""), ("rename", "/a", "/a2"), ("upsert", "/b2", ""), ("upsert", "/d", "")]


def test_a_feed_writes_each_batch_once(spark):
    source, checkpoint = shared_path(spark, "in"), shared_path(spark, "cp")
    ledger = Ledger(spark, shared_path(spark, "feed"))
    for k in range(3):
        spark.createDataFrame([(k, j) for j in range(k)], "k long, j long").coalesce(1).write.mode("append").parquet(source)
    tries = []

    def fold(df):
        tries.append(1)
        return df.withColumn("k", F.when(F.lit(len(tries) == 2), F.raise_error(F.lit("died"))).otherwise(F.col("k")))

    progress = Progress()
    spark.streams.addListener(progress)
    stream = lambda: feed(spark.readStream.schema("k long, j long").option("maxFilesPerTrigger", 1).parquet(source), ledger, checkpoint, fold, {"availableNow": True}, name="feed")
    try:
        with pytest.raises(Exception, match="died"):
            stream().awaitTermination()
        stream().awaitTermination()
        stream().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(progress)
    assert sorted((r.k, r.j) for r in ledger.rows("k long, j long").collect()) == [(1, 0), (2, 0), (2, 1)]
    assert not ledger.put(spark.createDataFrame([(9, 9)], "k long, j long"), 0)  # committed before
    assert ledger.committed().agg(F.sum("n")).first()[0] == 3
    kinds = [r.report for r in progress.to_df(spark).collect()]
    assert "started" in kinds and "progress" in kinds and "failed" in kinds and "complete" in kinds
    assert Ledger(spark, shared_path(spark, "none")).committed().count() == 0


def test_bad_rows_go_aside(spark):
    c = small_catalog(spark)
    rows = [
        ("/a/new.png", 1, 5, at(0)), ("/a/new.png", 1, 6, at(9)), ("/a/new.png", 1, 7, at(5)), ("/a/Dragon.png", 1, 100, at(1)), (None, 1, 5, at(0)), ("", 1, 5, at(0)),
        ("/a/n1", None, 5, at(0)), ("/a/n2", 4242, 5, at(0)), ("/a/n3", 1, None, at(0)), ("/a/n4", 1, -1, at(0)), (None, 4242, None, at(0)),
    ]
    given = spark.createDataFrame([(p, f, "n", 1, 1, s, "png", m, m) for p, f, s, m in rows], "path string, folder_id long, filename string, width int, height int, size long, format string, modified_at timestamp, created_at timestamp")
    done, told, bad, seen = writes.upsert_checked(c, given, c.images)
    assert sorted((r.reason, r.path or "", r.size or 0) for r in bad.collect()) == sorted([("no path", "", 5), ("no path", "", 5), ("no path", "", 0), ("no folder", "/a/n1", 5), ("no folder", "/a/n2", 5), ("no size", "/a/n3", 0), ("no size", "/a/n4", -1), ("repeated", "/a/new.png", 5), ("repeated", "/a/new.png", 7)])
    assert sorted((r.path, r.is_new) for r in told.collect()) == [("/a/Dragon.png", False), ("/a/new.png", True)]
    assert seen.get == {"good": 2, "bad": 9}
    assert done.images.count() == c.images.count() + 1 and done.images.where("path = '/a/new.png'").first().size == 6
    none = writes.upsert_checked(c, given.limit(0), c.images)
    assert none[2].count() == 0 and none[0].images.count() == c.images.count()


def test_folders_merge_and_change_places_at_once(spark):
    folders = [(1, None, "/a"), (2, 1, "/a/x"), (3, 2, "/a/x/y"), (4, None, "/b"), (5, 4, "/b/x"), (6, 5, "/b/x/z"), (7, None, "/p"), (8, 7, "/p/in"), (9, None, "/q"), (10, None, "/one"), (11, None, "/two")]
    images = [(k, f, f"{p}/i{k}") for k, f, p in ((1, 1, "/a"), (2, 2, "/a/x"), (3, 3, "/a/x/y"), (4, 5, "/b/x"), (5, 8, "/p/in"), (6, 9, "/q"), (7, 10, "/one"), (8, 11, "/two"))]
    c = small_catalog(spark).put(
        folders=spark.createDataFrame([(*f, f[2].rsplit("/", 1)[1], f[1] is None) for f in folders], "id long, parent_id long, path string, name string, is_root boolean"),
        images=spark.createDataFrame(images, "id long, folder_id long, path string"),
    )
    renames = [("/a", "/b"), ("/a/x/y", "/a/x/why"), ("/p", "/q"), ("/q", "/p"), ("/one", "/new"), ("/two", "/new"), ("/none", "/other"), ("/b/x/z", "/b/x/z")]
    done, unknown = rename_folders(c, spark.createDataFrame(renames, "path string, to_path string"))
    assert [r.path for r in unknown.collect()] == ["/none"]
    assert {r.id: (r.parent_id, r.path, r.name) for r in done.folders.collect()} == {
        4: (None, "/b", "b"), 5: (4, "/b/x", "x"), 3: (5, "/a/x/why", "why"), 6: (5, "/b/x/z", "z"), 7: (None, "/q", "q"), 8: (7, "/q/in", "in"), 9: (None, "/p", "p"), 10: (None, "/new", "new"),
    }
    assert {r.id: (r.folder_id, r.path) for r in done.images.collect()} == {1: (4, "/b/i1"), 2: (5, "/b/x/i2"), 3: (3, "/a/x/why/i3"), 4: (5, "/b/x/i4"), 5: (8, "/q/in/i5"), 6: (9, "/p/i6"), 7: (10, "/new/i7"), 8: (10, "/new/i8")}


def test_counters_are_the_same_in_any_order(spark):
    base = spark.createDataFrame([("total", None, 10), ("folder", 1, 3), ("tag", 7, 1)], "kind string, key long, count long")
    deltas = [spark.createDataFrame(x, "kind string, key long, removed long, added long") for x in ([("folder", 1, 4, 0), ("total", None, 4, 0)], [("folder", 1, 0, 2), ("folder", 2, 0, 5)], [("tag", 7, 3, 0), ("total", None, 0, 1)])]
    want = {("total", None, 7), ("folder", 1, 1), ("folder", 2, 5), ("tag", 7, 0)}
    for steps in ((0, 1, 2), (2, 0, 1, 0, 2), (0, "c0", 1, "c1", 0, 2, "c2", 1)):
        log = stats.CounterLog(spark, shared_path(spark, "counters"))
        log.start(base)
        assert {tuple(r) for r in log.read().collect()} == {tuple(r) for r in base.collect()}
        for step in steps:
            log.compact(int(step[1:])) if isinstance(step, str) else log.append(deltas[step], step)
        assert {tuple(r) for r in log.read().collect()} == want


def test_a_batch_that_comes_again_is_not_told_again(spark, monkeypatch):
    plans, append = [], stats.CounterLog.append

    def seen(log, deltas, batch):
        plans.append(deltas._jdf.queryExecution().optimizedPlan().toString())
        append(log, deltas, batch)

    monkeypatch.setattr(stats.CounterLog, "append", seen)
    assert not upkeep.ag11_merge_on_read(spark, "/root/testdata/sf0.001").isEmpty()
    assert len(plans) == 7 and not any("Join" in p or "Aggregate" in p for p in plans)


def test_tables_of_many_ids_are_merged_however_small_their_files(spark, monkeypatch):
    """The planner would broadcast them: it takes the size of compressed files for that of rows."""
    folders = small_catalog(spark).folders.where("id < 7")
    changes = spark.createDataFrame([("added", 1, 5, None, None), ("removed", 2, 4, None, [7]), ("updated", 3, 6, 2, None), ("added", 4, 42, None, None)], stats.CHANGES)
    plans = {}

    def seen(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, label)

    monkeypatch.setattr(shared, "FEW_ROWS", -1)
    for module in (hierarchy, intervals):
        monkeypatch.setattr(module, "materialize", seen)
    assert sorted((r.id, r.ancestor) for r in hierarchy.closure(folders).where("distance > 1").collect()) == [(4, 1), (5, 1), (5, 2)]
    assert sorted(r.id for r in hierarchy.subtree(folders, 2).collect()) == [2, 4, 5]
    told = {(r.kind, r.key): (r.removed, r.added) for r in seen(stats.counter_deltas(changes, folders), "deltas").where("kind LIKE 'folder%'").collect()}
    assert told["folder", 42] == told["folder_recursive", 42] == (0, 1) and told["folder_recursive", 1] == (2, 1) and told["folder_recursive", 5] == (0, 1)
    assert sorted((r.id, r.place, r.last) for r in intervals.intervals(folders, block=2).collect()) == [(1, 0, 4), (2, 1, 3), (3, 4, 4), (4, 2, 3), (5, 3, 3), (6, 5, 5)]
    joined = ("reach", "up", "way", "deltas", "links", "marks", "above", "further")
    assert not [label for label in joined if any("Broadcast" in p for p in plans.get(label, []))]
    assert all(any("SortMergeJoin" in p for p in plans[label]) for label in joined)


@pytest.mark.parametrize(("by", "order"), [("size", "asc"), ("size", "desc"), ("format", "asc"), ("filename", "desc"), ("added_at", "desc"), ("rating", "asc"), (None, None)])
def test_pages_by_key_join_to_the_whole_sort(spark, by, order):
    c = small_catalog(spark)
    asked = LibraryQuery(sort_by=by, sort_order=order, limit=3)
    whole = [r.id for r in LibraryQuery(sort_by=by, sort_order=order).to_df(c).collect()]
    got, cursor = [], None
    for _ in range(10):
        page = asked.page_after(c, cursor)
        got += [r.id for r in page.collect()]
        cursor = asked.cursor(page)
        if cursor is None:
            break
    assert got == whole
    listed = LibraryQuery.listed(folder_id=2)
    assert (listed.sort_by, listed.sort_order, listed.limit, listed.folder_id) == ("modified_at", "desc", 100, 2)


@pytest.mark.parametrize(("by", "order"), [("size", "asc"), ("size", "desc"), ("format", "asc"), ("filename", "desc"), ("added_at", "desc")])
def test_large_pages_pass_through_no_single_task(spark, monkeypatch, by, order):
    c = small_catalog(spark)
    whole = [r.id for r in LibraryQuery(sort_by=by, sort_order=order).to_df(c).collect()]
    large = LibraryQuery(sort_by=by, sort_order=order, limit=2_000)
    for page in (large.to_df(c), large.page_after(c), LibraryQuery(sort_by=by, sort_order=order, offset=3).to_df(c)):
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" not in plan and "Limit" not in plan and "Offset" not in plan
    monkeypatch.setattr(search, "ONE_TASK", 0)
    for offset, limit in ((0, 3), (2, 4), (5, 9), (7, -1), (99, 2), (99, -1), (2, 0)):
        want = whole[offset:] if limit < 0 else whole[offset : offset + limit]
        assert [r.id for r in LibraryQuery(sort_by=by, sort_order=order, limit=limit, offset=offset).to_df(c).collect()] == want
    asked, got, cursor = LibraryQuery(sort_by=by, sort_order=order, limit=3), [], None
    for _ in range(4):
        page = asked.page_after(c, cursor)
        got += [r.id for r in page.collect()]
        cursor = asked.cursor(page)
    assert got == whole and cursor is None


def plain_rows(widths, container, height, gap, stretch=1.2):
    rows, used = [], 0
    for k, w in enumerate(widths):
        if rows and used + w + gap <= container:
            used += w + gap
            rows[-1].append(k)
        else:
            rows.append([k])
            used = w
    y, out = 0.0, {}
    for n, row in enumerate(rows):
        scale = (container - (len(row) - 1) * gap) / sum(widths[k] for k in row)
        scale = 1.0 if n == len(rows) - 1 and scale > stretch else scale
        x = 0.0
        for k in row:
            out[k] = (x, y, widths[k] * scale, height * scale)
            x += widths[k] * scale + gap
        y += height * scale + gap
    return out


def test_justified_rows_of_large_and_small_galleries(spark):
    rng = random.Random(4)
    sizes = {"big": 900, "one": 1, None: 30, "wide": 12}
    rows = [(g, k, rng.choice((0.0, None, 0.5, 1.0, 1.5, 2.39)) if g != "wide" else 50.0) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, aspect double").repartition(5)
    got = layout.justified_layout(df, ["g"], [], 1200.0, 220.0, 16.0).collect()
    for g, n in sizes.items():
        widths = [220.0 * (a if a and a > 0 else 1.0) for h, _, a in rows if h == g]
        want = plain_rows(widths, 1200.0, 220.0, 16.0)
        mine = {r.id: (r.x, r.y, r.width, r.height) for r in got if r.g == g}
        assert sorted(mine) == list(range(n)) and all(mine[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    alone = layout.justified_layout(df.where("g = 'wide'").drop("g"), [], [], 1200.0, 220.0, 16.0)
    assert alone.columns == ["id", "x", "y", "width", "height"] and alone.count() == 12
    assert layout.justified_layout(df.limit(0), ["g"], [], 1200.0, 220.0, 16.0).count() == 0


def test_headers_that_end_early_or_lie(spark):
    jpeg = "FFD8FFE000044141FFFFC0001108000A001403"
    codes = {
        "whole": jpeg, "cut": jpeg[:-12], "no frame": "FFD8FFE000044141FFD9", "garbage": "FFD8FF" + "12" * 30, "loop": "FFD8FFE00000FFE00000", "tables": "FFD8FFC4000411AAFFC8000411AAFFC2001108000100020100",
        "tiff out": "49492A00FFFFFFFF0000", "tiff none": "4D4D002A000000080000", "webp": "52494646AAAAAAAA57454250", "empty": "", "png": "89504E470D0A1A0A0000000D4948445200000007000000090806", "text": "68656C6C6F",
    }
    df = spark.createDataFrame([(n, bytearray.fromhex(c), 1) for n, c in codes.items()] + [("null", None, 1)], "name string, head binary, width int")
    got = {r.name: (r.width, r.height) for r in files.header_dimensions(df).collect()}
    none = (None, None)
    assert got == {n: none for n in (*codes, "null")} | {"whole": (20, 10), "tables": (2, 1), "png": (7, 9)}
    scanned = spark.createDataFrame([("a", "png", bytearray.fromhex(codes["png"]), T0), ("b", None, None, T0)], "path string, format string, head binary, modified_at timestamp")
    assert [(r.path, r.width, r.created_at) for r in files.file_metadata(scanned).collect()] == [("a", 7, T0)]


def test_thumbnail_names(spark):
    rows = spark.createDataFrame([("/a/b.png",), ("/a/c.png",), ("/a/b.png",), (None,)], "path string").select(media.thumbnail_name(F.col("path")).alias("n")).collect()
    assert rows[0] == rows[2] != rows[1] and rows[3].n is None and rows[0].n.endswith(".webp") and len(rows[0].n) == 21
