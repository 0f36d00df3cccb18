from __future__ import annotations

import hashlib
import math
import random
import time

import numpy as np
import pytest

from vitrine.llm import ann
from vitrine.llm.ann import search, usable
from vitrine.llm.decontaminate import Words, drop_leaks, find_leaks, index_items, matches
from vitrine.llm.warc import END, VERSION, _Writer, read_chunks, read_records, write_warc
from vitrine.sources.shared import shared_path

# archives

V = VERSION.decode()
PAGES = [
    (5, "http://a/5", "x" * 150),
    (3, "http://a/3", "x" * 150),
    (9, None, "x" * 150),
    (4, "http://a/4", "short"),
    (1, "http://a/1\r\nWARC-Type: evil", "short"),
    (2, "u", None),
    (6, "u", ""),
    (7, "u", "line\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 20),
    (8, "u", f"{V}{V}\r\n\r\n{V}" + "é" * 3000 + "\r\n\r\n"),
    (10, "u", "😀ü" * 5000 + "\r\n\r\n\r\n\r\n" + V),
    (11, "u", "\r\nWARC-Segment-Number: 3\r\n" * 10),
    (12, "u", "\r\n\r\n" * 100),
    (13, "u", "é" * 50),
    (14, "u", "é" * 49 + "x"),
]


def brute_records(pages):
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == raw and j is not None]
        first = min(same) if same and len(raw) >= 100 and i is not None else i
        out.append((i is None, i or 0, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 1000, 7])
def test_archives_round_trip(spark, chunk):
    rows = [*PAGES, (None, "u", "x" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "first").repartition(3)
    path = shared_path(spark, "w")
    write_warc(pages, path, uri_col="first", chunk_bytes=chunk)
    got = read_records(spark, path).collect()
    assert sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute_records(rows)
    chunks = read_chunks(spark, path).where("record_type = 'response'").collect()
    by: dict[str, list] = {}
    for c in chunks:
        by.setdefault((c.page_id, c.row), []).append((c.segment, bytes(c.payload)))
        assert len(c.payload) <= max(chunk, 8)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(b"".join(p for _, p in sorted(x)) == html[i] for (i, _), x in by.items())


def test_archives_of_nothing_and_repeats(spark):
    schema = "page_id long, url string, html string"
    for rows in ([], [(1, "u", "y" * 200), (1, "u", "y" * 200), (2, "u", "y" * 200)]):
        path = shared_path(spark, "w")
        write_warc(spark.createDataFrame(rows, schema), path)
        got = sorted((r.page_id, r.record_type, r.refers_to) for r in read_records(spark, path).collect())
        assert got == [(i, "response" if i == 1 else "revisit", None if i == 1 else 1) for i, _, _ in rows]


def test_slices_become_chunks_that_split_separators():
    rng = random.Random(4)
    for _ in range(300):
        payload = b"".join(rng.choice([b"a", "é".encode(), "😀".encode(), END, VERSION, b"\r\n"]) for _ in range(rng.randint(0, 30)))
        most, step = rng.randint(4, 40), rng.randint(1, 50)
        writer = _Writer({"WARC-Record-ID": "<urn:page:1>", "WARC-Payload-Length": len(payload)}, most)
        slices = [payload[k : k + step] for k in range(0, len(payload), step)] or [b""]
        records = [r for k, x in enumerate(slices) for r in writer.feed(x, k == len(slices) - 1)]
        bodies = [r.partition(END)[2] for r in records]
        bodies[0] = bodies[0].partition(END)[2]
        assert b"".join(bodies) == payload
        for k, x in enumerate(bodies):
            assert END + VERSION not in x and not x.startswith(VERSION) and len(x) <= most
            x.decode()
            assert (b"WARC-Segment-Number" in records[k]) == (len(bodies) > 1)


def test_a_long_payload_passes_in_pieces(spark):
    """Twenty megabytes: the writer holds two chunks and a slice at most, and what is read back is whole."""
    text = "".join(random.Random(1).choices("abcdefgh é\n", k=1 << 20)) * 20
    most, held = 1 << 15, 0
    raw = text.encode()
    writer = _Writer({"WARC-Record-ID": "<urn:page:1>", "WARC-Payload-Length": len(raw)}, most)
    for k in range(0, len(raw), most):
        for record in writer.feed(raw[k : k + most], k + most >= len(raw)):
            assert len(record) < most + 1000
        held = max(held, len(writer.held) + len(writer.waiting or b""))
    assert held <= 3 * most
    path = shared_path(spark, "w")
    write_warc(spark.createDataFrame([(1, "u", text), (2, "u", "short")], "page_id long, url string, html string"), path)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in read_records(spark, path).collect()}
    assert got[1] == (len(raw), hashlib.sha256(raw).hexdigest())
    assert read_chunks(spark, path).where("page_id = 1").count() > 600


# benchmark leaks

ITEM = "A farmer in Ohio sold 48 apples to Maria Lopez on Monday, and then she gave 12 km of rope to her brother Tom. How many apples does the farmer still have when he began with 96 apples today?"
OTHER = ITEM.replace("48", "31").replace("Maria Lopez", "Zoe Brown").replace("12 km", "7 miles").replace("Tom", "Jim").replace("96", "80").replace("Ohio", "Utah").replace("Monday", "Friday")
MIXED = OTHER.replace("80 apples", "31 pears").replace("gave", "took").replace("still", "even").replace("began", "ended")


def filler(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("stone river tall walking softly under window old green paper cup".split()) for _ in range(n))


def test_leaks_plain_and_with_other_values(spark, none):
    rng = random.Random(6)
    rows = [(1, filler(rng, 50) + " " + ITEM + " " + filler(rng, 50)), (2, ITEM.upper().lower()), (3, filler(rng, 300)), (4, filler(rng, 9) + ".\n" + OTHER), (5, MIXED), (6, None), (7, ""), (8, " ".join(ITEM.split()[:18])), (9, filler(rng, 40_000) + " " + ITEM), (None, ITEM), (1, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (13, filler(rng, 40))], "item_id long, text string")
    found = find_leaks(docs, bench).collect()
    got = sorted((r.doc_id or -1, r.item_id, r.changed) for r in found if r.doc_id != 2)
    assert got == [(-1, 10, False), (1, 10, False), (1, 10, False), (4, 10, True), (9, 10, False)]
    assert all(r.n_found >= 0.8 * r.n_windows for r in found)
    kept = drop_leaks(docs, bench)
    leaked = {r.doc_id for r in found}
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in leaked)
    blocked = find_leaks(docs, bench, block_bytes=100).collect()
    assert sorted(map(str, blocked)) == sorted(map(str, found))
    assert find_leaks(none, bench).count() == 0
    assert find_leaks(docs, bench.where("false")).count() == 0 and drop_leaks(docs, bench.where("false")).count() == len(rows)


def test_values_must_be_consistent(spark):
    """One value of the item that stands for two values here is another question."""
    item = "If a train has 30 cars and each of the 30 cars holds 30 boxes of 30 bolts then count the bolts in 30 trains of 30 cars."
    same = item.replace("30", "44")
    torn = item
    for k in range(6):
        torn = torn.replace("30", str(50 + k), 1)
    docs = spark.createDataFrame([(1, same), (2, torn)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert [(r.doc_id, r.changed) for r in find_leaks(docs, bench).collect()] == [(1, True)]


def test_leaks_with_a_word_exchanged_and_short_items(spark):
    """One changed word leaves 6 of 11 windows of an item of 15 words; items of under five tokens had no window at all."""
    item = "count how many green bottles are standing on our old wall when three have fallen".split()
    rng = random.Random(4)
    rows = []
    for k in range(len(item)):
        rows.append((k, f"{filler(rng, 30)} {' '.join(item[:k] + ['otherwise'] + item[k + 1 :])} {filler(rng, 20)}"))
    long = (item + [w + "s" for w in item])[:30]
    rows.append((50, " ".join(long[:4] + ["otherwise"] + long[5:9] + ["otherwise"] + long[10:])))
    rows += [(60, " ".join(item[:8])), (61, " ".join(w if k % 4 else "otherwise" for k, w in enumerate(item)))]
    short = [(70, filler(rng, 9) + ". Where was Anna Maria Lopez born? " + filler(rng, 9)), (71, "where was Tom born"), (72, "where is Tom born"), (73, "he had 12 km of rope"), (74, "he had 13 km of rope")]
    docs = spark.createDataFrame(rows + short, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(long)), (2, "Where was Anna Maria Lopez born?"), (3, "12 km"), (4, "  ")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.changed) for r in find_leaks(docs, bench).collect() if not (r.doc_id == 50 and r.item_id == 0))
    assert got == [(k, 0, False) for k in range(len(item))] + [(50, 1, False), (70, 2, False), (71, 2, True), (73, 3, False)]
    assert {r.doc_id for r in drop_leaks(docs, bench).collect()} == {60, 61, 72, 74}


def brute_leak(doc: list[str], item: list[str]) -> bool:
    """Whether a document of plain words has enough of an item of five words or more, by trying all places."""
    windows = [item[k : k + 5] for k in range(len(item) - 4)]
    has = lambda w: any(doc[k : k + 5] == w for k in range(len(doc) - 4))
    places = [k for k, w in enumerate(windows) if has(w)]
    tokens = {t for k in places for t in range(k, k + 5)}
    shifted = max((sum(0 <= s + k < len(doc) and doc[s + k] == w for k, w in enumerate(item)) for s in range(-len(item), len(doc))), default=0)
    return len(places) >= 0.8 * len(windows) or len(tokens) >= 0.8 * len(item) or bool(places) and shifted >= 0.9 * len(item)


def test_leaks_against_brute_force(spark):
    """Random plain words with exchanged, dropped, added and moved parts of items: what is found is what trying all places finds."""
    rng = random.Random(21)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)]
    items = [rng.sample(words, rng.randint(5, 45)) for _ in range(25)]
    docs = []
    for k in range(400):
        item = list(items[k % 25])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(item))
            item[at : at + rng.randint(0, 2)] = rng.choices(words, k=rng.randint(0, 2))
            item = item or ["x"]
        if rng.random() < 0.3:
            item = item[: rng.randint(1, len(item))]
        docs.append(rng.choices(words, k=rng.randint(0, 30)) + item + rng.choices(words, k=rng.randint(0, 30)))
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    want = sorted((d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if brute_leak(doc, item))
    assert 100 < len(want) < 400
    for block_bytes in (1 << 20, 1500):
        assert sorted((r.doc_id, r.item_id) for r in find_leaks(df, bench, block_bytes=block_bytes).collect()) == want


def test_figures_are_not_questions(spark):
    """Items of numbers match with their own numbers alone, and a long table of figures takes no time; windows of numbers between words still count."""
    rng = random.Random(8)
    figures = lambda n, most: " ".join(str(rng.randint(1, most)) for _ in range(n))
    items = [(k, figures(20, 999)) for k in range(1000)] + [(2000, "Add the numbers 11 22 33 44 55 66 77 and then give me the sum of them all"), (2001, "7"), (2002, "sum 5 5 5 5 5 5 5 5")]
    other = items[1000][1].replace("33", "3333").replace("66", "1")
    docs = [(1, figures(20_000, 99_999)), (2, figures(20_000, 9)), (3, figures(300, 99_999) + " " + items[5][1] + " " + figures(300, 99_999)), (4, filler(rng, 40) + " " + other), (5, items[5][1].replace(" ", " 1 "))]
    began = time.monotonic()
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert time.monotonic() - began < 60
    assert sorted((r.doc_id, r.item_id, r.changed) for r in found if r.item_id != 2001) == [(3, 5, False), (4, 2000, True)]
    assert {r.doc_id for r in found if r.item_id == 2001} == {d for d, text in docs if "7" in text.split()}


def test_stretches_of_items_tell_the_same(monkeypatch):
    """Pairs that are made for a few items at a time give what all at once give."""
    rng = random.Random(9)
    items = [(k, f"What is {k} plus {k + rng.randint(1, 9)} times {rng.randint(1, 9)} ? {filler(rng, k % 4)}") for k in range(60)]
    texts = [" ".join(f"What is {rng.randint(1, 99)} plus {rng.randint(1, 9)} times 3 ? {filler(rng, rng.randint(0, 3))}" for _ in range(80)) for _ in range(3)]
    index = index_items(items, 5)
    whole = list(matches(texts, index, Words(index.vocabulary), 5, 0.8))
    for most in (1, 500, 20_000):
        monkeypatch.setattr("vitrine.llm.decontaminate.MOST_HITS", most)
        assert sorted(matches(texts, index, Words(index.vocabulary), 5, 0.8)) == sorted(whole)
    assert len(whole) > 60


# neighbours


def brute_neighbours(vectors: dict[int, np.ndarray], every: int, k: int):
    ids = sorted(vectors)
    for q in ids:
        if q % every == 0:
            scored = sorted(((-float((vectors[q] * vectors[i]).sum()), i) for i in ids if i != q))
            yield q, [(i, -s) for s, i in scored[:k]]


def compare(rows, vectors, every, k, least):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    want = dict(brute_neighbours(vectors, every, k))
    assert set(by) == {q for q, x in want.items() if x}
    for q, truth in want.items():
        mine = sorted(by.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(truth) + 1))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        for _, i, s in mine:
            assert math.isclose(s, float((vectors[q] * vectors[i]).sum()), rel_tol=1e-12, abs_tol=1e-12)
        hits += len({i for _, i, _ in mine} & {i for i, _ in truth})
        total += len(truth)
    assert hits >= least * total


@pytest.mark.parametrize(("n", "clusters", "least"), [(400, 5, 0.9), (6_000, 40, 0.9), (50_000, 400, 0.9), (12_000, 0, 0.9)])
def test_neighbours_against_brute_force(spark, n, clusters, least):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 16))
    if clusters:
        x = rng.normal(size=(clusters, 16))[rng.integers(0, clusters, n)] + 0.4 * x
    x[n // 2 : n // 2 + 50] = x[0]
    every = max(20, n // 50)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(n + 20, None), (n + 40, [0.0] * 16), (n + 60, [float("nan")] * 16), (n + 1, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (n + 5, []), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = search(df, queries_every=every).collect()
    by = {r.query_id: [] for r in got}
    hits = total = 0
    for r in got:
        by[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by) == set(range(0, n, every))
    for q, mine in by.items():
        score = x @ x[q]
        score[q] = -np.inf
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in {m[1] for m in mine}
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        assert all(math.isclose(s, score[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, s in mine)
        hits += len({m[1] for m in mine} & {*np.lexsort((np.arange(n), -score))[:20].tolist()})
        total += 20
    assert hits >= least * total


def test_copies_are_found_by_their_smallest_ids(spark):
    """A vector that most rows share is one entry: all its queries find the smallest other ids."""
    x = np.random.default_rng(8).normal(size=(300, 8))
    x[20:280] = 3 * x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in search(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    for q in (40, 100, 260):
        assert [got[q][k] for k in range(1, 21)] == [i for i in range(20, 60) if i != q][:20]


def test_lists_with_little_chance_arent_probed(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 24))[rng.integers(0, 60, 20_000)] + 0.3 * rng.normal(size=(20_000, 24))
    index = ann.fit(x, len(x), 20)
    assert index.probes(x[:200], 21)[0].mean() < 0.25


def test_the_sample_is_a_share_of_the_table(spark, monkeypatch):
    """Tables of any size are searched by an index that hasn't seen most of them; only a few hundred vectors give more."""
    seen = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda sample, rows, k: seen.append((len(sample), rows)) or fit(sample, rows, k))
    x = np.random.default_rng(6).normal(size=(3_000, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    search(df, queries_every=500).collect()
    search(df.where("vec_id < 200"), queries_every=50).collect()
    search(df, queries_every=500, train_rows=300).collect()
    assert 600 < seen[0][0] < 900 and 180 < seen[1][0] <= 200 and 280 < seen[2][0] < 400


def test_dimensions_must_agree(spark):
    with pytest.raises(ValueError, match="dimensions"):
        search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>"))


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema)).count() == 0
    assert search(spark.createDataFrame([(0, [1.0, 2.0])], schema)).count() == 0
    x = {0: np.array([1.0, 2.0]), 1: np.array([2.0, 1.0]), 2: np.array([2.0, 1.0]), 20: np.array([-1.0, 0.5])}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], schema)
    compare(search(df).collect(), x, 20, 20, 1.0)
    assert usable(spark.createDataFrame([(1, None)], schema), "vec_id", "embedding")[1] == 0


def test_groups_hold_a_bounded_number_of_queries_and_rows(spark, monkeypatch):
    """Of one cell that all queries probe, no group gets all queries; each query meets each row once, and results are the same."""
    cell_of, blocks_of = ann.cells(np.array([2_000, 7, 5]), 100)
    assert cell_of.tolist() == [0, 1, 1] and blocks_of.tolist() == [20, 1, 1]
    probes = spark.range(3_000).selectExpr("0L AS cell", "id AS query").unionByName(spark.range(5).selectExpr("1L AS cell", "id AS query"))
    entries = spark.range(2_000).selectExpr("0L AS list", "id AS node").unionByName(spark.range(7).selectExpr("2L AS list", "id + 5000 AS node"))
    asking, held = ann.dealt(probes, entries, cell_of, blocks_of, query_rows=100)
    for side in (asking, held):
        assert max(r["count"] for r in side.groupBy("cell", "block", "part").count().collect()) <= 160
    met = asking.join(held, ["cell", "block", "part"])
    assert met.count() == met.select("query", "node").distinct().count() == 3_000 * 2_000 + 5 * 7
    x = np.random.default_rng(3).normal(size=(900, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = sorted(map(tuple, search(df).collect()))
    monkeypatch.setattr(ann.dealt, "__defaults__", (10,))
    monkeypatch.setattr(ann.cells, "__defaults__", (64,))
    assert sorted(map(tuple, search(df).collect())) == want
