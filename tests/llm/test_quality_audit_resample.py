"""Quality classifier, filter audit and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import quality
from vitrine.llm.audit import audit_filters, failure_masks, quality_filters
from vitrine.llm.resample import resample
from vitrine.sources.shared import materialize

# audit


def brute_mask(text: str, i, first) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        bool(re.search(r"[#$%&*|]", text)),
        i != first,
    )
    return sum(f << k for k, f in enumerate(fails))


def brute_audit(rows, labels):
    lowest = lambda i: (i is not None, i or 0)
    first: dict[str, int | None] = {}
    for i, text, _ in rows:
        t = text or ""
        first[t] = min(first.get(t, i), i, key=lowest)
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    docs = [(lang or "", brute_mask(text or "", i, first[text or ""]), i in good, i in toxic) for i, text, lang in rows]
    out = set()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = [0] * 5
        told = []
        for order in permutations(range(5)):
            before = 0
            for step, f in enumerate(order):
                gone = [d for d in own if not d[1] & before and d[1] >> f & 1]
                shapley[f] += len(gone)
                late = sum(1 for d in own if d[1] & before and d[1] >> f & 1)
                kept = sum(1 for d in own if not d[1] & (before | 1 << f))
                told.append((f, "".join("ABCDE"[x] for x in order), step + 1, kept, len(gone), late, sum(d[1] == 1 << f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)))
                before |= 1 << f
        out |= {(part, *t[1:], shapley[t[0]]) for t in told}
    return out


AUDITED = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_against_brute_force(spark):
    rng = random.Random(1)
    prose = lambda n, k: " ".join(f"w{rng.randrange(k)}" for _ in range(n))
    texts = [None, "", " ", "\t\n", "A" * 40, "x|y", "é" * 300, "\x1c\x85 nbsp\xa0x", prose(150, 10_000), prose(150, 20), prose(99, 10_000), prose(100, 10_000), prose(120, 10_000).upper(), prose(130, 9_999) + " $", prose(30_000, 10**6)]
    rows = [(k, texts[k % len(texts)], ("en", "de", None, "")[k % 4]) for k in rng.sample(range(1, 400), 90)]
    copy = prose(140, 10_000)
    rows += [(1000 + k, copy, "en") for k in range(300)] + [(7000, "twice", "fr")] * 2 + [(7001, "twice", "fr"), (None, "twice", "fr"), (None, "twice", "xx"), (None, "no id", None)]
    rng.shuffle(rows)
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i, _, _ in rows if rng.random() < 0.6] + [(None, 1, 1), (-5, 1, 1), (1000, 0, 1), (1000, 1, 0)]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, lang string, mask int, part string").withColumnRenamed("part", "words").repartition(6)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit_filters(docs, marked)
    assert found.columns == list(AUDITED)
    got = [tuple(r) for r in found.collect()]
    want = brute_audit(rows, labels)
    assert len(got) == len(want) == 600 * 5 and set(got) == want


def test_copies_over_many_ranges(spark):
    """Copies of one text, by far the most of the rows, lie in many ranges; only the smallest id isn't one."""
    docs = spark.range(5000).select((F.col("id") * 7 % 5003).alias("doc_id"), F.when(F.col("id") % 5 > 0, "the same").otherwise(F.concat(F.lit("own "), "id")).alias("text"), F.lit("en").alias("lang")).repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        masks = failure_masks(docs, quality_filters()).select("id", F.col("mask").bitwiseAND(16).alias("e")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    same = {k * 7 % 5003 for k in range(5000) if k % 5}
    assert len(masks) == 5000 and {r["id"] for r in masks if r["e"]} == same - {min(same)}


def test_audit_of_nothing(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(none.withColumn("lang", F.lit("en")), labels).count() == 0
    one = audit_filters(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels, conditions={"A": F.size("words") < 1}, duplicates="B").collect()
    assert sorted((r.part, r.filter_order, r.step, r.kept, r.removed, r.shapley) for r in one) == [("", "AB", 1, 0, 1, 2), ("", "AB", 2, 0, 0, 0), ("", "BA", 1, 1, 0, 0), ("", "BA", 2, 0, 1, 2)]


# resampling


def brute_runs(text) -> list[str]:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def brute_resample(rows, target, percent, least, buckets):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for run in brute_runs(x)[1]:
                counts[bucket(run)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    told = []
    for i, x in rows:
        words, runs = brute_runs(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(r)] for r in runs)
        told.append((i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)))
    drawable = sorted((x for x in told if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    n = len(drawable) * percent // 100
    out = [(*x[:4], k + 1 if k < n else None) for k, x in enumerate(drawable)]
    return sorted(out + [(*x[:4], None) for x in told if x[4] < least], key=str)


@pytest.mark.parametrize(("percent", "least"), [(5, 20), (50, 3), (100, 0)])
def test_resampling_against_brute_force(spark, docs, texts, percent, least):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    target = [texts[3], "ÄÖÜ äöü the of And", None, "", "a b"]
    bench = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = resample(docs.withColumnRenamed("key", "score"), bench, percent=percent, least_words=least, buckets=500)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == brute_resample(rows, target, percent, least, 500)


def test_resampling_of_nothing(spark, none, docs):
    bench = spark.createDataFrame([(1, "the house")], "item_id long, text string")
    assert resample(none, bench).count() == 0
    told = resample(docs, bench.where("false"), buckets=100)
    assert told.count() == docs.count() and told.where("n_features = 0 AND weight <> 0").count() == 0


# quality


def some_texts(rng: random.Random, n: int):
    """Good prose, shouting, repetition and strewn symbols."""
    word = lambda: "".join(rng.choice("the an er in on at ing ed re ou ha".split()) for _ in range(rng.randint(1, 3)))
    for k in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        kind = k % 6
        if kind == 0:
            yield " ".join(w.upper() + "!!" for w in words), 0
        elif kind == 1:
            yield " ".join([words[0]] * 30 + [words[1]] * 30), 0
        elif kind == 2:
            yield " ".join(w + rng.choice(("$$$", "###", "***")) for w in words), 0
        else:
            yield ". ".join(" ".join(words[j : j + 8]).capitalize() for j in range(0, len(words), 8)) + ".", 1


def test_quality_is_learned(spark):
    rows = [(k, x, q) for k, (x, q) in enumerate(some_texts(random.Random(5), 900))]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "no id"), (5000, None), (5001, ""), (5002, "word " * 200_000), (3, "another text of id three")], "doc_id long, text string").withColumn("score", F.lit("old")).repartition(5)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None), (9999, 0), (11, rows[11][2])], "doc_id long, quality int")
    train = ~quality.held_out()
    model = quality.fit(docs.where(train), labels.where(train))
    told = quality.score(docs, model)
    assert told.columns == ["doc_id", "text", "score"]
    got = told.collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got if r.doc_id != 3}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 150 and sum((by[i] >= 0.7) == (q == 1) for i, q in held) >= 0.97 * len(held)
    assert by[5000] == by[5001] and by[5002] < 0.5
    again = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs.where(train).repartition(2), labels.where(train).coalesce(1))).collect() if r.doc_id != 3}
    assert all(math.isclose(by[k], again[k], abs_tol=1e-9) for k in by)


def test_one_label_or_none(spark, docs, none):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    all_good = quality.score(docs, quality.fit(docs, labels)).select("score").distinct().collect()
    assert len(all_good) == 1 and all_good[0][0] > 0.9
    assert [r[0] for r in quality.score(docs, quality.fit(docs, labels.where("false"))).select(F.round("score", 9)).distinct().collect()] == [0.5]
    assert quality.score(none, quality.fit(none, labels)).count() == 0


def test_pieces_of_a_text_have_its_indicators(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(("The", "the", "x!!", "é", "12", "\n", "a|b")) for _ in range(n)) for n in (0, 1, 2, 3, 50, 4000)] + ["", "  ", "x"]
    whole = [quality.indicators(x.encode()) for x in texts]
    assert all((np.diff(x) > 0).all() and (not len(x) or 0 <= x[0] and x[-1] < quality.BUCKETS) for x in whole)
    monkeypatch.setattr(quality, "PIECE", 64)
    assert all((a == quality.indicators(x.encode())).all() for a, x in zip(whole, texts))


def test_counts_and_the_fit_against_their_definitions(spark):
    """Log-count ratios are those of counting; after enough rounds every row's dual weight fits its margin."""
    rows = [(k, x, bool(q)) for k, (x, q) in enumerate(some_texts(random.Random(8), 120))]
    blocks = materialize(quality._blocks(spark.createDataFrame(rows, "id long, text string, good boolean"), 3), "blocks")
    told = sorted((r.asDict() for r in blocks.collect()), key=lambda r: r["block"])
    ratio, bad, good = quality._ratios(blocks, 1.0)
    counts, n = np.ones((2, quality.BUCKETS)), [0, 0]
    for r in told:
        for label, kept, found in zip(*quality._unpack(r)):
            if not kept:
                counts[int(label > 0), found] += 1
                n[int(label > 0)] += 1
    assert [bad, good] == n and sum(n) < 120
    assert np.allclose(ratio, np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum()))
    w, bias, alphas, cost = np.zeros(quality.BUCKETS), 0.0, {}, (1.5, 0.8)
    for _ in range(25):
        for r in quality._round(blocks, ratio, w, bias, alphas, 3, cost):
            alphas[r["block"]] = np.frombuffer(r["alpha"])
            w[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["change"], "f4")
            bias += r["own"]
    for r in told:
        for label, kept, found, alpha in zip(*quality._unpack(r), alphas[r["block"]]):
            if kept:
                assert alpha == 0
                continue
            margin = label * (w[found] @ ratio[found] / np.sqrt(ratio[found] @ ratio[found]) + bias)
            top = cost[int(label > 0)]
            assert (alpha > 1e-9 or margin > 0.97) and (alpha < top - 1e-9 or margin < 1.03) and (not 1e-9 < alpha < top - 1e-9 or abs(margin - 1) < 0.03)
