from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from vitrine.llm.simhash import Plan, allocate, hamming_links, majority_bits, near_copies, near_duplicates, parities, plan_search, shingle_hashes, sketch_distance
from vitrine.llm.components import components


def brute_print(text: str | None, words: int = 3) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    runs = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates_match_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    links = [(a, b) for a in range(len(order)) for b in range(a) if (prints[order[a]] ^ prints[order[b]]).bit_count() <= 3]
    comp = roots(len(order), links)
    want = sorted((rows[order[i]][0] is None, rows[order[i]][0] or 0, prints[order[i]], rows[order[comp[i]]][0] or -1) for i in range(len(order)))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, -1 if r.component_id is None else r.component_id or -1) for r in near_duplicates(docs).collect())
    assert got == want


def test_near_duplicates_of_nothing(none):
    assert near_duplicates(none).count() == 0
    assert near_copies(none).count() == 0


def test_majority_of_large_texts():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 255, 256, 1000, 0, 7])
    h = rng.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    got = majority_bits(h, sizes)
    at = 0
    for n, x in zip(sizes, got, strict=True):
        own = [int(v) for v in h[at : at + n]]
        assert int(x) == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in own) > n)
        at += n


@pytest.mark.parametrize("radius", [0, 3, 6, 9])
def test_links_lose_no_pair(spark, radius):
    """Clusters near each other, hot keys among them, against all pairs."""
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {rng.getrandbits(64) for _ in range(150)}
    for c in centres:
        for _ in range(60):
            x = c
            for b in rng.sample(range(64), rng.randint(0, radius + 2)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x, k) for k, x in enumerate(prints)], "fp long, node long").repartition(3)
    links = hamming_links(df, radius, bucket_rows=16)
    got = roots(len(prints), [(r.a, r.b) for r in links.collect()])
    want = roots(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= radius])
    assert got == want



def test_thresholds_are_the_cheapest_that_cover_the_radius():
    costs = [{-1: 0.0, 0: 1.0, 1: 9.0, 2: 20.0}, {-1: 0.0, 0: 5.0, 1: 6.0, 2: 7.0}]
    assert allocate(3, costs) == (7.0 + 1.0, (0, 2))


def test_plan_is_unequal_where_it_pays(spark):
    """Bits that are nearly constant tell nothing alone, so the plan must still sum up."""
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.getrandbits(20), k) for k in range(500)], "fp long, node long")
    plan = plan_search(df, 3)
    assert isinstance(plan, Plan)
    assert sum(plan.thresholds) == 3 - len(plan.masks) + 1
    assert sum(m.bit_count() for m in plan.masks) == 64


def test_components_of_chains_and_loops(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (102, 102), (200, 150), (150, 199), (200, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0}
    assert got[101] == 100 and got[200] == got[199] == got[150] == 150 and 102 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_by_similarity(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, groups = [], []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(150, 400))
        for c in range(4):
            w = base.copy()
            for _ in range(len(w) * c // 250):  # up to about 1.2 % of the words
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w).title() if c == 3 else " ".join(w)))
            groups.append(g)
    rows += [(len(rows), None), (len(rows) + 1, "  "), (len(rows) + 2, "one")]
    groups += [-1, -1, -2]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {k: groups.index(g) for k, g in enumerate(groups)}
    assert got == want


def test_sketch_distance_grows_as_similarity_falls():
    assert 0 == sketch_distance(1.0) < sketch_distance(0.9) < sketch_distance(0.8) < 64


def test_near_copies_are_all_that_brute_force_finds(spark, docs):
    """Copies with an added or replaced block, at similarities around the limit, where one SimHash of short runs lost up to two fifths."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(30_000)}"
    passage = [word() for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in range(60):
        base = [word() for _ in range(rng.randint(60, 400))] + (passage if k % 3 == 0 else [])
        part = round(len(base) * rng.uniform(0.08, 0.3))
        block = [word() for _ in range(part)]
        for w in (base, base + block, block + base, base[: len(base) // 2] + block + base[len(base) // 2 + part // 2 :]):
            rows.append((10_000 + len(rows), " ".join(w)))
    rng.shuffle(rows)
    found = [set(shingle_hashes(t, 5)) for _, t in rows]
    root = list(range(len(rows)))

    def top(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        x, y = found[a], found[b]
        if rows[a][0] is not None and rows[b][0] is not None and (x == y or len(x & y) >= 0.8 * len(x | y)):
            root[top(b)] = top(a)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    want = sorted((i, least[top(k)]) for k, (i, _) in enumerate(rows) if i is not None)
    given = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for got in (near_copies(given), near_copies(given, bucket_rows=3)):
        assert sorted((r.doc_id, r.component_id) for r in got.collect() if r.doc_id is not None) == want


def test_parities_differ_in_no_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 2**64, 400, np.uint64)
    sets = [np.zeros(0, np.uint64), *(np.unique(np.concatenate([shared[:k], rng.integers(0, 2**64, k // 3, np.uint64)])) for k in (0, 1, 5, 60, 90, 300, 400)), shared[:0]]
    sizes = np.array([len(x) for x in sets])
    told = np.array(parities(np.concatenate(sets), sizes)).view(np.uint64)
    for a, b in combinations(range(len(sets)), 2):
        apart = int(np.bitwise_count(told[:, a] ^ told[:, b]).sum())
        differ = len(np.setxor1d(sets[a], sets[b]))
        assert apart <= differ and (apart - differ) % 2 == 0
    assert not told[:, 0].any() and not told[:, -1].any() and not np.any(parities(sets[0], sizes[:0]))
