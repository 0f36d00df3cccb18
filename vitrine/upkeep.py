"""Registered queries over deep trees, indices, streams and batches of changes; they go into the same tables as those of queries.py."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.functions import media
from vitrine.operators import hierarchy, intervals, stats, writes
from vitrine.plans import search
from vitrine.plans.search import LibraryQuery
from vitrine.queries import AFTER, COUNTERS, EVENTS, STEPS, _events, query
from vitrine.sources import files, formats
from vitrine.sources.catalog import Catalog, star_catalog
from vitrine.sources.shared import few, materialize, shared_path, table
from vitrine.sources.trigrams import TrigramIndex
from vitrine.streaming import changes
from vitrine.streaming.apply import rename_folders
from vitrine.streaming.ledger import Ledger, feed
from vitrine.streaming.waits import final_removals, keyed_state, met_halves

# Deep trees: every order hangs on the one before it, but every seventh on the one seven before; each thousand has a root, up to 1,000 levels above its leaves.

DEEP = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 1000 > 0 THEN CASE WHEN o_orderkey % 7 > 0 OR o_orderkey % 1000 < 7 THEN o_orderkey - 1 ELSE o_orderkey - 7 END END AS parent_id FROM orders"
DEEP_CLOSURE = "SELECT id, id AS ancestor, 0 AS distance FROM deep UNION ALL SELECT c.id, d.parent_id, c.distance + 1 FROM deep_closure c JOIN deep d ON c.ancestor = d.id JOIN deep p ON d.parent_id = p.id"
deep_tables = {"deep": DEEP, "deep_closure": DEEP_CLOSURE}


def deep_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parent = F.when(k % 1000 > 0, F.when((k % 7 > 0) | (k % 1000 < 7), k - 1).otherwise(k - 7))
    return table(spark, sf_dir, "orders").select(k.alias("id"), parent.alias("parent_id"))


@query("set1_deep_subtree", "SELECT id FROM below", deep=DEEP, below="SELECT id FROM deep WHERE id = 1001 UNION ALL SELECT d.id FROM below b JOIN deep d ON d.parent_id = b.id")
def set1_deep_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.subtree(deep_tree(spark, sf_dir), 1001)


@query(
    "set1_intervals",
    """SELECT c.id, CAST(sum(shift) AS BIGINT) AS place, CAST(sum(shift) AS BIGINT) + any_value(s.size) - 1 AS last, count(*) - 1 AS depth
    FROM deep_closure c JOIN shifts a ON c.ancestor = a.id JOIN sizes s ON c.id = s.id GROUP BY c.id""",
    sizes="SELECT ancestor AS id, count(*) AS size FROM deep_closure GROUP BY ancestor",
    shifts="""SELECT d.id, coalesce(sum(size) OVER (PARTITION BY p.id ORDER BY d.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (p.id IS NOT NULL)::INT AS shift
        FROM deep d JOIN sizes s ON d.id = s.id LEFT JOIN deep p ON d.parent_id = p.id""",
    **deep_tables,
)
def set1_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intervals(deep_tree(spark, sf_dir)).select("id", "place", "last", "depth")


@query("ag5_deep_counts", "SELECT ancestor AS id, CAST(coalesce(sum(n), 0) AS BIGINT) AS count FROM deep_closure c LEFT JOIN (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1) l ON c.id = l.id GROUP BY ancestor", **deep_tables)
def ag5_deep_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).count()
    return intervals.counts_below(intervals.intervals(deep_tree(spark, sf_dir)), held)


@query(
    "wr12_deep_delete",
    "SELECT d.id, d.parent_id, count(l_suppkey) AS images FROM deep d LEFT JOIN lineitem ON l_orderkey = d.id WHERE d.id NOT IN (SELECT id FROM deep_closure WHERE ancestor IN (SELECT min(id) FROM deep WHERE id % 1000 = 3)) GROUP BY ALL",
    **deep_tables,
)
def wr12_deep_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items are the images of a folder for each order; the first thousand's third folder goes, with all below it."""
    nodes = deep_tree(spark, sf_dir)
    folders = nodes.withColumns({"path": F.concat(F.lit("/"), "id"), "name": F.col("id").cast("string"), "is_root": F.col("parent_id").isNull()})
    images = table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("folder_id"))
    top = nodes.where("id % 1000 = 3").agg(F.min("id")).first()[0]
    left = writes.delete_folder(Catalog(spark, {"folders": folders, "images": images}), top)
    held = left.images.groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("images"))
    return left.folders.select("id", "parent_id").join(held, "id", "left").select("id", "parent_id", F.coalesce("images", F.lit(0)).alias("images"))


@query("flt3_place_range", "SELECT i.id, i.folder_id FROM images i WHERE i.folder_id IN (SELECT id FROM closure WHERE ancestor = 104)")
def flt3_place_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of a subtree, from a table kept in order of their folders' numbers, by one range of them."""
    c = star_catalog(spark, sf_dir)
    spans = materialize(intervals.intervals(c.folders, ["name"]), "spans")
    kept = materialize(intervals.placed(c.images.select("id", "folder_id"), few(spans), "folder_id", "folder_place"), "placed")
    return kept.where(intervals.inside(spans, 104, "folder_place")).select("id", "folder_id")


# An index of trigrams over all documents: texts of one language change, long ones of another go.

PATTERNS = ("ción", "LICENSED under", "the and", "_der_", "er", "no such words", "a\nb")
EDITED = "SELECT doc_id, CASE WHEN lang = 'de' THEN replace(text, ' ', '_') || ' ' || source ELSE text END AS text FROM documents WHERE NOT coalesce(lang = 'fr' AND n_chars > 1000, false)"


@query("flt8_trigram_index", "SELECT pattern, doc_id FROM edited, (VALUES " + ", ".join("('" + p.replace("\n", "' || chr(10) || '") + "')" for p in PATTERNS) + ") v(pattern) WHERE length(pattern) >= 3 AND contains(lower(text), lower(pattern))", edited=EDITED)
def flt8_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "n_chars", "source")
    index = TrigramIndex(spark, shared_path(spark, "trigrams")).build(docs)
    gone = F.coalesce((F.col("lang") == "fr") & (F.col("n_chars") > 1000), F.lit(False))
    edited = docs.where((F.col("lang") == "de") | gone).select("id", F.concat(F.replace("text", F.lit(" "), F.lit("_")), F.lit(" "), "source").alias("text"), gone.alias("gone"))
    index.update(edited, 1)
    found = [index.contains(p).select(F.lit(p).alias("pattern"), F.col("id").alias("doc_id")) for p in PATTERNS]
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    return told


# Streams over whole events. Files arrive in order of time, a part of the events each, and the query is started anew for each part with its checkpoint.

PARTS, STATES = 3, 16


def _arrivals(spark: SparkSession, events: DataFrame, at: str) -> Iterator[tuple[int, DataFrame]]:
    """The parts of `events`, of equal stretches of time, one after the other."""
    events = materialize(events.withColumn("at_us", F.unix_micros(F.col(at).cast("timestamp"))), "events")
    first, last = events.agg(F.min("at_us"), F.max("at_us")).first()
    step = (last - first) // PARTS + 1
    for k in range(PARTS):
        yield k, events.where((F.col("at_us") >= first + k * step) & (F.col("at_us") < first + (k + 1) * step)).drop("at_us")


def _run(spark: SparkSession, parts: Iterable[DataFrame], schema: StructType, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream `build` writes when each part arrives while it isn't running."""
    source, out, checkpoint = (shared_path(spark, x) for x in ("arrivals", "told", "offsets"))
    with keyed_state(spark, partitions=STATES):
        for part in parts:
            part.write.mode("append").parquet(source)
            stream = build(spark.readStream.schema(schema).parquet(source))
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "st7_tombstones",
    """SELECT path, ts AS since, event_id AS seq FROM (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS next FROM
        (SELECT event_id, ts, '/u/' || user_id AS path, event_type IN ('error', 'view') AS gone FROM events))
    WHERE gone AND coalesce(next > ts + INTERVAL 2 HOUR, ts + INTERVAL 2 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 SECOND)""",
)
def st7_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals that stay for two hours, by a stream that keeps what waits in its state over two restarts."""
    kind = F.when(F.col("event_type").isin("error", "view"), "remove").otherwise("upsert")
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("/u/"), "user_id").alias("path"), kind.alias("kind"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"))
    told = _run(spark, (part for _, part in _arrivals(spark, events, "at")), events.schema, lambda s: final_removals(s, grace_seconds=7200))
    return told.select("path", F.col("since").cast("timestamp_ntz").alias("since"), "seq")


HALVES = """SELECT event_id AS tracker, ts AS from_at, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN '/old/' || event_id END AS path,
    CASE WHEN event_type IN ('click', 'purchase', 'error') THEN '/new/' || event_id END AS to_path, ts + CAST(floor(value * 60) AS BIGINT) * INTERVAL 1 SECOND AS to_at FROM events WHERE event_type <> 'signup'"""


@query(
    "st4_split_renames",
    """SELECT 'rename' AS op, path, to_path, tracker FROM halves WHERE path IS NOT NULL AND to_path IS NOT NULL AND to_at <= from_at + INTERVAL 20 MINUTE
    UNION ALL SELECT 'remove', path, NULL, tracker FROM halves WHERE path IS NOT NULL AND (to_path IS NULL OR to_at > from_at + INTERVAL 20 MINUTE)
    UNION ALL SELECT 'upsert', to_path, NULL, tracker FROM halves WHERE to_path IS NOT NULL AND (path IS NULL OR to_at > from_at + INTERVAL 20 MINUTE)""",
    halves=HALVES,
)
def st4_split_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halves of renames, the second one up to an hour after the first, that a stream reads in three parts and pairs within 20 minutes."""
    kind, e = F.col("event_type"), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    later = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * 60).cast("long") * 1_000_000)
    half = lambda k, path, at: (F.lit("/r").alias("root"), F.lit(k).alias("kind"), F.col("event_id").alias("tracker"), F.concat(F.lit(path), "event_id").alias("path"), at.alias("at"))
    first = e.where(kind.isin("view", "click", "purchase")).select(*half("rename_from", "/old/", F.col("ts")))
    second = e.where(kind.isin("click", "purchase", "error")).select(*half("rename_to", "/new/", later))
    halves = first.unionByName(second)
    end = spark.createDataFrame([("/end", "rename_from", -1, "/end"), ("/end", "rename_to", -2, "/end")], "root string, kind string, tracker long, path string").withColumn("at", F.lit("2100-01-01 00:00:00").cast("timestamp"))
    parts = [part for _, part in _arrivals(spark, halves, "at")]
    told = _run(spark, [*parts, end], halves.schema, lambda s: met_halves(s, wait="20 MINUTES"))
    return told.select("op", "path", "to_path", "tracker")


@query("snk2_feed", "SELECT part, path, CASE WHEN arg_max(kind, seq) = 'remove' THEN 'remove' WHEN arg_max(is_dir, seq) THEN 'add_folder' ELSE 'add' END AS op, arg_max(size, seq) AS size FROM (SELECT *, '/p' || least(floor((ts_us - first) / step), 2)::INT AS part FROM timed, bounds) GROUP BY part, path", feed_events=EVENTS.replace("FROM events", ", epoch_us(ts) AS ts_us FROM events"), timed="SELECT * FROM feed_events", bounds="SELECT min(ts_us) AS first, (max(ts_us) - min(ts_us)) // 3 + 1 AS step FROM feed_events")
def snk2_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of what each trigger of 600 ms comes to; the query is stopped after its first batch and started again."""
    events = _events(spark, sf_dir).join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "ts"), "seq")
    source, checkpoint = shared_path(spark, "arrivals"), shared_path(spark, "offsets")
    ledger = Ledger(spark, shared_path(spark, "feed"))
    for k, part in _arrivals(spark, events, "ts"):
        part.drop("ts").withColumn("root", F.lit(f"/p{k}")).coalesce(1).write.mode("append").parquet(source)  # a file each, so a trigger each
    schema = spark.read.parquet(source).schema
    stream = lambda: feed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), ledger, checkpoint, changes.coalesce)
    started = stream()
    while started.isActive and ledger.committed().isEmpty():
        time.sleep(0.2)
    started.stop()
    started = stream()
    started.processAllAvailable()
    started.stop()
    return ledger.rows("root string, op string, path string, size long").select(F.col("root").alias("part"), "path", "op", "size")


# Writes and layouts over whole tables.

REGIONS = {"/ASIA": "/EUROPE", "/AFRICA": "/AMERICA", "/AMERICA": "/AFRICA", "/MIDDLE EAST": "/LEVANT"}
HEAD = "CASE " + " ".join(f"WHEN path = '{a}' OR starts_with(path, '{a}/') THEN '{b}' || substr(path, {len(a) + 1})" for a, b in REGIONS.items()) + " ELSE path END"


@query(
    "wr9_merge_renames",
    f"""SELECT f.id, CASE WHEN f.parent_id = 3 THEN 4 ELSE f.parent_id END AS parent_id, CASE WHEN n.path IS NOT NULL THEN '/ORIENT/' || n.name || substr(f.path, length(n.path) + 1) ELSE {HEAD.replace("path", "f.path")} END AS path,
        coalesce(i.n, 0) AS images FROM folders f LEFT JOIN (SELECT path, name FROM folders WHERE parent_id = 5) n ON f.path = n.path OR starts_with(f.path, n.path || '/')
        LEFT JOIN (SELECT CASE WHEN folder_id = 3 THEN 4 ELSE folder_id END AS folder_id, count(*) AS n FROM images GROUP BY 1) i ON i.folder_id = f.id WHERE f.id <> 3""",
)
def wr9_merge_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region merged into another, two that change places, one renamed with all its nations going elsewhere: one batch."""
    c = star_catalog(spark, sf_dir)
    regions = spark.createDataFrame(list(REGIONS.items()), "path string, to_path string")
    nations = c.folders.where("parent_id = 5").select("path", F.concat(F.lit("/ORIENT/"), "name").alias("to_path"))
    done, _ = rename_folders(c, regions.unionByName(nations))
    held = done.images.groupBy(F.col("folder_id").alias("id")).agg(F.count(F.lit(1)).alias("images"))
    return done.folders.join(held, "id", "left").select("id", "parent_id", "path", F.coalesce("images", F.lit(0)).alias("images"))


BATCH = """SELECT CASE WHEN o_orderpriority <> '1-URGENT' THEN '/orders/' || o_custkey || '/Order_' || CASE WHEN o_orderpriority = '2-HIGH' THEN o_custkey ELSE o_orderkey END END AS path,
    o_custkey + CASE WHEN o_orderpriority = '5-LOW' THEN 100000000 ELSE 1000 END AS folder_id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(floor(o_totalprice) AS BIGINT) END AS size, o_orderkey, o_orderdate FROM orders"""


@query(
    "snk1_quarantine",
    """SELECT coalesce(reason, CASE WHEN i.path IS NULL THEN 'new' ELSE 'known' END) AS state, count(*) AS n FROM (
        SELECT path, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY path, reason IS NULL, CASE WHEN reason IS NOT NULL THEN o_orderkey END ORDER BY o_orderdate DESC, size DESC) > 1 THEN 'repeated' ELSE reason END AS reason FROM (
        SELECT b.*, CASE WHEN b.path IS NULL THEN 'no path' WHEN size IS NULL THEN 'no size' WHEN f.id IS NULL THEN 'no folder' END AS reason FROM batch b LEFT JOIN folders f ON b.folder_id = f.id)) j
    LEFT JOIN images i ON j.path = i.path GROUP BY 1""",
    batch=BATCH,
)
def snk1_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch with a row for each order, of which some have no path, size or folder, or a path twice; how many come to what. Nothing is gone from disk, so there are no moves."""
    c = star_catalog(spark, sf_dir)
    p, k = F.col("o_orderpriority"), F.col("o_custkey")
    path = F.when(p != "1-URGENT", F.concat(F.lit("/orders/"), k, F.lit("/Order_"), F.when(p == "2-HIGH", k).otherwise(F.col("o_orderkey"))))
    files = table(spark, sf_dir, "orders").select(
        path.alias("path"),
        (k + F.when(p == "5-LOW", 100_000_000).otherwise(1000)).alias("folder_id"),
        F.lit("n").alias("filename"), *(F.lit(1).alias(c) for c in ("width", "height")),
        F.when(p != "4-NOT SPECIFIED", F.floor("o_totalprice").cast("long")).alias("size"),
        F.lit("png").alias("format"), F.col("o_orderdate").alias("modified_at"), F.col("o_orderdate").alias("created_at"),
    )
    _, told, bad, _ = writes.upsert_checked(c, files, c.images)
    states = bad.select(F.col("reason").alias("state")).unionByName(told.select(F.when(F.col("is_new"), "new").otherwise("known").alias("state")))
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("srt6_seek_pages", "SELECT id, CAST((row_number() OVER (ORDER BY size ASC NULLS LAST, lower(filename), id) - 1) // ((SELECT count(*) FROM images) // 4 + 1) AS BIGINT) AS page FROM images")
def srt6_seek_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images, a page after the other, each from where the one before ended."""
    c = star_catalog(spark, sf_dir)
    c = c.put(images=materialize(c.images, "images"))
    asked = LibraryQuery.listed(sort_by="size", sort_order="asc", limit=c.images.count() // 4 + 1)
    pages, cursor = [], None
    while len(pages) == 0 or cursor is not None:
        page = materialize(asked.page_after(c, cursor), "page")
        pages.append(page.select("id", F.lit(len(pages)).cast("long").alias("page")))
        cursor = asked.cursor(page)
    told = pages[0]
    for more in pages[1:]:
        told = told.unionByName(more)
    return told


@query("ag11_merge_on_read", AFTER, before=COUNTERS, steps=STEPS)
def ag11_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after three batches (removed, added and moved images, each of one format), with a batch that comes again and a compaction between them."""
    c = star_catalog(spark, sf_dir)
    held = c.image_tags.groupBy("image_id").agg(F.collect_list("tag_id").alias("tag_ids"))
    i, none = c.images, F.lit(None).cast("long")
    gone = i.where("format = 'jpg'").select(F.lit("removed").alias("op"), F.col("id").alias("image_id"), "folder_id", none.alias("old_folder_id")).join(held, "image_id", "left")
    tags = F.lit(None).cast("array<long>").alias("tag_ids")
    born = i.where("format = 'jpeg'").select(F.lit("added").alias("op"), F.col("id").alias("image_id"), F.lit(1001).cast("long").alias("folder_id"), none.alias("old_folder_id"), tags)
    moved = i.where("format = 'png'").select(F.lit("updated").alias("op"), F.col("id").alias("image_id"), F.lit(1002).cast("long").alias("folder_id"), F.col("folder_id").alias("old_folder_id"), tags)
    ways = hierarchy.closure(c.folders)
    log = stats.CounterLog(spark, shared_path(spark, "counters"))
    log.start(stats.counters(c))
    # a batch that comes again is not told again
    batches = [materialize(stats.counter_deltas(b.select("op", "image_id", "folder_id", "old_folder_id", "tag_ids"), c.folders, ways), "deltas") for b in (moved, born, gone)]
    for k in (0, 1, 0):
        log.append(batches[k], k)
    log.compact(0)
    for k in (0, 1, 2, 2):
        log.append(batches[k], k)
    return log.read()


# Files made of orders: a header of each kind, by priority and status, that holds an order's width and height behind others of its segments.

SIZES = "SELECT o_orderkey AS id, o_orderkey % 4000 + 1 AS width, o_orderkey % 3000 + 1 AS height, CASE o_orderpriority WHEN '1-URGENT' THEN 'JPEG Image' WHEN '2-HIGH' THEN 'WebP Image' WHEN '3-MEDIUM' THEN 'TIFF Image' WHEN '4-NOT SPECIFIED' THEN 'PNG Image' ELSE 'GIF Image' END AS format_name FROM orders"


def made_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, head) of a file for each order; names say nothing of the kind."""
    k = F.col("o_orderkey")
    w, h = k % 4000 + 1, k % 3000 + 1
    big = lambda x, n: F.format_string(f"%0{2 * n}X", x)
    little = lambda x, n: F.concat(*(F.substring(big(x, n), 2 * j + 1, 2) for j in reversed(range(n))))
    pad = F.col("o_custkey") % 300
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFE1"), big(pad + 2, 2), F.expr("repeat('C0', CAST(o_custkey % 300 AS INT))"), F.lit("FFFFDB0003AAFFC4000411FF"), F.when(F.col("o_orderstatus") == "F", "FFC2").otherwise("FFC0"), F.lit("001108"), big(h, 2), big(w, 2), F.lit("03012200"))
    lossless = little(F.shiftleft(h - 1, 14) + (w - 1), 4)
    webp = F.concat(F.lit("52494646AAAAAAAA57454250"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("565038580A00000000000000"), little(w - 1, 3), little(h - 1, 3))).when(F.col("o_orderstatus") == "O", F.concat(F.lit("5650384C0A0000002F"), lossless)).otherwise(F.concat(F.lit("565038200A000000AAAAAA9D012A"), little(w, 2), little(h, 2))))
    tiff = F.when(
        F.col("o_orderstatus") == "F",
        F.concat(F.lit("49492A0010000000AAAAAAAAAAAAAAAA0300FE00040001000000000000000001030001000000"), little(w, 2), F.lit("00000101040001000000"), little(h, 4)),
    ).otherwise(F.concat(F.lit("4D4D002A0000000800020100000400000001"), big(w, 4), F.lit("0101000300000001"), big(h, 2), F.lit("0000")))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2))
    p = F.col("o_orderpriority")
    code = F.when(p == "1-URGENT", jpeg).when(p == "2-HIGH", webp).when(p == "3-MEDIUM", tiff).when(p == "4-NOT SPECIFIED", png).otherwise(gif)
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("/files/"), k, F.lit(".txt")).alias("path"), F.unhex(code).alias("head"))


@query("src2_headers", "SELECT id, width, height FROM sizes", sizes=SIZES)
def src2_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.header_dimensions(made_files(spark, sf_dir)).select("id", "width", "height")


@query("src4_detect_content", "SELECT id, format_name FROM sizes", sizes=SIZES)
def src4_detect_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.detect(made_files(spark, sf_dir), formats.registry(spark), content_col="head").select("id", "format_name")


# The rest of what the catalog's checks, thumbnails and waveforms tell, over whole tables.

BROKEN = {
    "folders_b": "SELECT id, parent_id, CASE WHEN parent_id = 104 THEN '/same' ELSE path END AS path FROM folders WHERE path <> '/ASIA'",
    "images_b": "SELECT id, CASE WHEN format = 'jpg' THEN folder_id + 100000000 ELSE folder_id END AS folder_id, CASE WHEN format = 'png' THEN '/dup/' || folder_id ELSE path END AS path FROM images WHERE NOT starts_with(filename, 'part.')",
    "tags_b": "SELECT id, 'T' || order_index AS name FROM tags WHERE order_index <> 3",
    "links_b": "SELECT * FROM image_tags UNION ALL SELECT l.* FROM image_tags l JOIN tags ON tag_id = id AND order_index = 2",
}


def _twice(rule: str, of: str, key: str) -> str:
    return f"SELECT '{rule}' AS rule, {key} AS key, count(*) AS n FROM {of} GROUP BY {key} HAVING count(*) > 1"


def _lost(rule: str, of: str, column: str, to: str) -> str:
    return f"SELECT '{rule}' AS rule, CAST({column} AS VARCHAR) AS key, count(*) AS n FROM {of} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {to}) GROUP BY {column}"


@query(
    "ck_all_rules",
    " UNION ALL ".join(
        (
            _twice("folders.path", "folders_b", "path"), _twice("images.path", "images_b", "path"), _twice("tags.name", "tags_b", "name"), _twice("image_tags", "links_b", "image_id || '/' || tag_id"),
            _lost("folders.parent_id", "folders_b", "parent_id", "folders_b"), _lost("images.folder_id", "images_b", "folder_id", "folders_b"),
            _lost("image_tags.image_id", "links_b", "image_id", "images_b"), _lost("image_tags.tag_id", "links_b", "tag_id", "tags_b"),
        )
    ),
    **BROKEN,
)
def ck_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog that breaks every rule."""
    c = star_catalog(spark, sf_dir)
    folders = c.folders.where("path <> '/ASIA'").withColumn("path", F.when(F.col("parent_id") == 104, "/same").otherwise(F.col("path")))
    images = c.images.where("filename NOT LIKE 'part.%'").withColumn("path", F.when(F.col("format") == "png", F.concat(F.lit("/dup/"), "folder_id")).otherwise(F.col("path")))
    images = images.withColumn("folder_id", F.when(F.col("format") == "jpg", F.col("folder_id") + 100_000_000).otherwise(F.col("folder_id")))
    tags = c.tags.where("order_index <> 3").withColumn("name", F.concat(F.lit("T"), "order_index"))
    again = c.image_tags.join(c.tags.where("order_index = 2").select(F.col("id").alias("tag_id")), "tag_id", "left_semi").select("image_id", "tag_id")
    return c.put(folders=folders, images=images, tags=tags, image_tags=c.image_tags.unionByName(again)).violations()


@query("flt32_limited", "SELECT least(count(*), 50) AS n, count(*) = 0 AS is_empty FROM images WHERE thumbnail_path IS NULL AND thumbnail_attempts < 3")
def flt32_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many images without a thumbnail as a batch takes, whichever they are."""
    n = F.count(F.lit(1))
    return search.needs_thumbnail(star_catalog(spark, sf_dir).images, limit=50).agg(n.alias("n"), (n == 0).alias("is_empty"))


@query(
    "ag12_peaks",
    """SELECT user_id, CAST(k - 1 AS BIGINT) AS place, peaks[k] / top AS peak FROM (SELECT *, list_max(peaks) AS top FROM (SELECT user_id, CASE WHEN len(loud) <= 16 THEN loud
        ELSE list_transform(range(16), lambda p: list_max(loud[p * (len(loud) // 16) + 1 : (p + 1) * (len(loud) // 16)])) END AS peaks FROM sounds)), unnest(range(1, len(peaks) + 1)) u(k)""",
    sounds="SELECT user_id, list(abs(value - 30) ORDER BY event_id) AS loud FROM events GROUP BY user_id",
)
def ag12_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen peaks of what each user's events were worth, as of a sound's samples."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") - 30).alias("value")))).alias("samples"))
    peaks = rows.select("user_id", F.posexplode(media.waveform(F.transform("samples", lambda x: x["value"]), points=16)).alias("place", "peak"))
    return peaks.select("user_id", F.col("place").cast("long").alias("place"), "peak")


@query(
    "wr8_scan_folders",
    "SELECT DISTINCT '/orders/7/Order_' || o_orderkey AS path, '/orders/7' AS parent FROM orders WHERE o_custkey = 7 UNION ALL SELECT '/orders/7', NULL FROM (SELECT 1 FROM orders WHERE o_custkey = 7 LIMIT 1)",
)
def wr8_scan_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders for all orders' paths as far as they lie in the scanned one."""
    c = star_catalog(spark, sf_dir)
    done = writes.ensure_folders(c, c.images.select("path"), root="/orders/7").folders
    above = done.select(F.col("id").alias("parent_id"), F.col("path").alias("parent"))
    return done.where("path LIKE '/orders%'").join(above, "parent_id", "left").select("path", "parent")


@query("set6_list_upkeep", "SELECT id, filename FROM images WHERE NOT coalesce(format = 'jpg', false) AND (rating >= 4 OR rating <= 1 OR size > 100000 AND rating = 3)")
def set6_list_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of the best rated images, after all jpg went and what is large or badly rated came, of which some is there already."""
    i = star_catalog(spark, sf_dir).images.select("id", "filename", "format", "rating", "size")
    page = i.where("rating <= 1 OR size > 100000 AND rating >= 3")
    return search.listed_after(i.where("rating >= 4"), i.where("format = 'jpg'"), page).select("id", "filename")
