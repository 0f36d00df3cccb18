"""Media expressions, layouts, and the change feed."""

from __future__ import annotations

import random
from datetime import datetime as T

import numpy as np
import pytest
from catalogs import small_catalog
from pyspark.sql import functions as F

from vitrine.functions import media
from vitrine.operators import layout, stats
from vitrine.sources.shared import shared_path
from vitrine.streaming import changes


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def test_sizes(spark):
    sizes = {0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1 KB", 1536: "1.5 KB", 1152: "1.13 KB", 2**20: "1 MB", 5 * 2**30 + 2**29: "5.5 GB", 3 * 2**40: "3 TB", 3000 * 2**40: "3000 TB"}
    df = spark.createDataFrame([(k,) for k in sizes], "s long")
    assert {r.s: r.t for r in df.select("s", media.format_size(F.col("s")).alias("t")).collect()} == sizes
    assert one(spark, media.to_bytes(F.lit(1.5), "KB")) == 1536 and one(spark, media.to_bytes(F.lit(0.0005), "KB")) == 1


def test_segments(spark):
    lengths = lambda d: [s.length for s in one(spark, media.segments(F.lit(d)))]
    assert lengths(25.0) == [10.0, 10.0, 5.0] and lengths(30.0) == [10.0] * 3 and len(lengths(3600.0)) == 360 and lengths(0.0) == []
    text = one(spark, media.playlist(F.lit("test.mkv"), F.lit(25.0), F.lit("standard")))
    assert text.startswith("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:10\n") and text.endswith("#EXTINF:5.000,\n/segment/test.mkv/2.ts?quality=standard\n#EXT-X-ENDLIST\n")


def test_codes(spark):
    lit = F.lit
    assert one(spark, media.quality_field(lit("LOW"), "video_bitrate")) == 4_000_000 and one(spark, media.quality_field(lit("x"), "crf")) is None
    assert one(spark, media.quality_field(lit("standard"), "audio_bitrate")) == 256_000 and one(spark, media.quality_field(lit("high"), "preset")) == "slow"
    native = lambda v, a: one(spark, media.is_codec_native(lit(v), lit(a)))
    assert native("h264", "aac") and native(None, None) and native("h264", "opus") and not native("hevc", "aac") and not native("vp9", "opus")
    assert one(spark, media.is_linear(lit("MPG"), lit(None))) and not one(spark, media.is_linear(lit("mkv"), lit("matroska")))
    assert one(spark, media.stream_url(lit("/a b*~+é"), lit("Audio"), lit("Native"), lit(None))) == "audio://localhost/%2Fa%20b%2A~%2B%C3%A9"
    assert one(spark, media.stream_url(lit("x"), lit(None), lit(None), lit("high"))) == "video-stream://localhost/x?quality=high"
    assert tuple(one(spark, media.segment_of(lit("%2Fa%2Fb+c.mkv/42.ts")))) == ("/a/b+c.mkv", 42) and one(spark, media.segment_of(lit("/a/b"))) is None
    assert one(spark, media.icon_category(lit("PSD"))) == "design" and one(spark, media.icon_color(lit(None))) == "rgb(120, 120, 120)"
    keys = [one(spark, media.cache_key(lit("p"), lit(q), lit(5))) for q in ("low", "high", "low")]
    assert keys[0] == keys[2] != keys[1] and len(keys[0]) == 16
    assert one(spark, media.stars(lit(3))) == "★★★" and one(spark, media.dimensions_label(lit(4), lit(None))) is None and one(spark, media.aspect_ratio(lit(4), lit(0))) == 1.0


def brute_wave(x, points):
    loud = [abs(v) for v in x]
    if len(loud) > points:
        step = len(loud) // points
        loud = [max(loud[k * step : (k + 1) * step]) for k in range(points)]
    top = max(loud, default=0)
    return [v / top for v in loud] if top > 0 else loud


def test_waveform(spark):
    rng = random.Random(1)
    waves = [[], [0.0, 0.0], [rng.uniform(-1, 1) for _ in range(500)], [rng.uniform(-1, 1) for _ in range(1999)], [rng.uniform(-9, 9) for _ in range(7)]]
    df = spark.createDataFrame(list(enumerate(waves)), "k int, x array<double>")
    for points in (3, 500):
        for r in df.select("k", media.waveform(F.col("x"), points).alias("w")).collect():
            assert r.w == pytest.approx(brute_wave(waves[r.k], points))


def test_layouts(spark):
    rng = random.Random(2)
    items = [(g, k * 7 % 101, rng.choice([None, 0.0, 0.5, 1.0, 2.5])) for g in ("a", "b") for k in range(100)]
    df = spark.createDataFrame(items, "g string, id long, aspect double").repartition(5)
    width, n = (1000 - 3 * 10) / 4, 4
    for g in ("a", "b"):
        heights, want = np.zeros(n, np.float32), {}
        for _, i, aspect in sorted(x for x in items if x[0] == g):
            at = int(heights.argmin())
            tall = width / (aspect or 1.0)
            want[i] = (at * (width + 10), float(heights[at]), tall)
            heights[at] += np.float32(tall + 10)
        got = layout.masonry_layout(df, ["g"], [], 1000.0, 240.0, 10.0).where(F.col("g") == g).collect()
        assert [x for r in sorted(got, key=lambda r: r.id) for x in (r.x, r.y, r.height)] == pytest.approx([x for i in sorted(want) for x in want[i]])
    rows = layout.justified_layout(df, ["g"], [], 1000.0, 200.0, 10.0).where("g = 'a'").orderBy("y", "x").collect()
    lines = {}
    for r in rows:
        lines.setdefault(r.y, []).append(r)
    tops = sorted(lines)
    for y in tops[:-1]:
        assert sum(r.width for r in lines[y]) + 10 * (len(lines[y]) - 1) == pytest.approx(1000)
        assert lines[y][0].height + 10 + y == pytest.approx(tops[tops.index(y) + 1])
    assert [r.id for y in tops for r in lines[y]] == sorted(i for g, i, _ in items if g == "a")
    grid = {r.id: (r.x, r.y) for r in layout.grid_layout(df.where("g = 'a'"), [], 1000.0, 240.0, 10.0).collect()}
    assert [grid[i] for i in sorted(grid)] == [(k % 4 * (width + 10), k // 4 * (width + 10)) for k in range(100)]
    assert layout.grid_layout(df.where("false"), [], 1000.0, 240.0, 10.0).count() == 0 and layout.masonry_layout(df.where("false"), [], [], 1000.0, 240.0, 10.0).count() == 0


def events(spark, rows):
    """rows: seq, kind, path, to_path, tracker, is_dir"""
    return spark.createDataFrame([("/r", s, k, p, t, tr, d, s, T(2024, 1, 1)) for s, k, p, t, tr, d in rows], changes.EVENTS)


def ops(df):
    return sorted((r.op, r.path, r.to_path) for r in df.collect())


def test_coalescing(spark):
    got = changes.coalesce(
        events(
            spark,
            [
                (1, "upsert", "/a", None, None, False),
                (2, "remove", "/a", None, None, False),
                (3, "remove", "/b", None, None, False),
                (4, "upsert", "/b", None, None, False),
                (5, "upsert", "/d", None, None, True),
                (6, "rename", "/d", "/e", None, True),
                (7, "rename", "/old", "/new", None, False),
                (8, "rename_from", "/f", None, 5, False),
                (9, "rename_to", "/g", None, 5, False),
                (10, "rename_from", "/h", None, 6, False),
                (11, "rename_to", "/i", None, 7, False),
                (12, "rename_from", "/j", None, None, False),
                (13, "upsert", "/k", None, None, False),
                (14, "rename_from", "/k", None, 8, False),
                (15, "rename_to", "/l", None, 8, False),
                (16, "rename", "/l", "/m", None, False),
                (17, "upsert", "/k", None, None, False),
            ],
        )
    )
    want = [("add", "/b", None), ("add", "/i", None), ("add", "/k", None), ("add", "/m", None), ("add_folder", "/e", None), ("remove", "/a", None), ("remove", "/h", None), ("remove", "/j", None), ("rename", "/f", "/g"), ("rename", "/old", "/new")]
    assert ops(got) == want
    assert changes.coalesce(events(spark, [])).count() == 0


def test_coalescing_is_a_fold(spark):
    """Against the events one by one."""
    rng = random.Random(9)
    rows, paths = [], [f"/p{k}" for k in range(8)]
    for s in range(300):
        kind = rng.choice(["upsert", "upsert", "remove"])
        rows.append((s, kind, rng.choice(paths), None, None, rng.random() < 0.3))
    state = {}
    for _, kind, p, _, _, d in rows:
        state[p] = "remove" if kind == "remove" else "add_folder" if d else "add"
    assert ops(changes.coalesce(events(spark, rows))) == sorted((op, p, None) for p, op in state.items())


def test_untracked_pairs(spark):
    catalog = small_catalog(spark)
    rows = [("/r", "remove", "/a/b/dragÓn_a.jpg", None, False, None, None), ("/r", "add", "/x/new.jpg", None, False, 200, T(2024, 1, 1, 0, 0, 0, 500_000)), ("/r", "remove", "/q/one", None, None, None, None), ("/r", "add_folder", "/q/two", None, True, None, None), ("/r", "remove", "/a/Dragon.png", None, False, None, None), ("/r", "add", "/y.png", None, False, 99, T(2024, 1, 1))]
    df = spark.createDataFrame(rows, "root string, op string, path string, to_path string, is_dir boolean, size long, created_at timestamp")
    assert ops(changes.pair_untracked(df, catalog.images)) == [("add", "/y.png", None), ("remove", "/a/Dragon.png", None), ("rename", "/a/b/dragÓn_a.jpg", "/x/new.jpg"), ("rename", "/q/one", "/q/two")]
    own = changes.without_own(events(spark, [(1, "upsert", "/r/.app/x", None, None, False), (2, "rename", "/r/a", "/r/.app", None, False), (3, "upsert", "/r/.apple", None, None, False)]), "/r/.app/")
    assert [r.seq for r in own.collect()] == [3]


def test_grace(spark):
    catalog = small_catalog(spark)
    pending = spark.createDataFrame([("/a/Dragon.png", T(2024, 1, 1, 0, 0, 0)), ("/a/b/c/a", T(2024, 1, 1, 0, 0, 1)), ("/taken", T(2024, 1, 1, 0, 0, 0))], "path string, since timestamp")
    due, waiting = changes.due_removals(pending, catalog.images, F.lit(T(2024, 1, 1, 0, 0, 2)))
    assert [r.path for r in due.collect()] == ["/a/Dragon.png"] and [r.path for r in waiting.collect()] == ["/a/b/c/a"]


def test_stream_keeps_counters(spark, tmp_path):
    """Three batches through a stream, one tried twice, come to the counters of one batch."""
    catalog = small_catalog(spark).materialized()
    parts = [[("added", 100, 5, None, None)], [("removed", 1, 1, None, [1, 2]), ("updated", 2, 3, 2, None)], [("added", 101, 7, None, None)]]
    source = tmp_path / "changes"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, stats.CHANGES).coalesce(1).write.mode("append").parquet(str(source))
    state = changes.Counters(shared_path(spark, "state"), catalog.folders)
    state.start(stats.counters(catalog))
    seen = []

    def handle(batch, batch_id):
        state.apply(batch, batch_id)
        if not seen:
            state.apply(batch, batch_id)
        seen.append(batch_id)

    stream = spark.readStream.schema(stats.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(source))
    changes.watch(stream, str(tmp_path / "offsets"), handle, {"availableNow": True}).awaitTermination()
    whole = stats.apply_deltas(stats.counters(catalog), stats.counter_deltas(spark.createDataFrame([r for p in parts for r in p], stats.CHANGES), catalog.folders))
    told = lambda df: sorted((r.kind, r.key or 0, r["count"]) for r in df.where("count > 0").collect())
    assert seen == [0, 1, 2] and told(state.current(spark, 3)) == told(whole)


def test_events_arrive_as_files(spark, tmp_path):
    events(spark, [(1, "upsert", "/a", None, None, False), (2, "remove", "/a", None, None, False)]).write.parquet(str(tmp_path / "e"))
    got = []
    changes.watch(changes.events_stream(spark, str(tmp_path / "e")), str(tmp_path / "o"), lambda df, _: got.extend(ops(changes.coalesce(df))), {"availableNow": True}).awaitTermination()
    assert got == [("remove", "/a", None)]
    counts = changes.tumbling_counts(spark.createDataFrame([(T(2024, 1, 1, 0, 0, 0, 100_000), "x"), (T(2024, 1, 1, 0, 0, 0, 700_000), "x")], "ts timestamp, event_type string"))
    assert sorted(r.n for r in counts.collect()) == [1, 1]
