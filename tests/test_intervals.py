"""Subtrees by doubling, trees as intervals."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from vitrine.operators import hierarchy, intervals
from vitrine.operators.numbering import running_sum
from vitrine.sources.shared import materialize

NODES = "id long, parent_id long"


def below(rows: list[tuple], root: int) -> set[int]:
    children: dict = {}
    for i, p in rows:
        children.setdefault(p, []).append(i)
    seen, todo = set(), [root] if any(i == root for i, _ in rows) else []
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += children.get(at, [])
    return seen


def checked(spark, rows: list[tuple], roots: list[int], walked: list[int]) -> None:
    """Ranges of numbers hold the subtrees of `roots`; those of `walked` are also looked up one by one."""
    nodes = spark.createDataFrame(rows, NODES)
    spans = materialize(intervals.intervals(nodes), "spans")
    found = {r["id"]: r for r in spans.collect()}
    assert sorted(r["place"] for r in found.values()) == list(range(len(rows)))
    for root in roots:
        want = below(rows, root)
        assert {i for i, r in found.items() if root in found and found[root]["first"] <= r["place"] <= found[root]["last"]} == want
        if root in walked:
            assert {r["id"] for r in hierarchy.subtree(nodes, root).collect()} == want
            assert {r["id"] for r in spans.where(intervals.inside(spans, root)).collect()} == want


def test_a_thousand_levels(spark):
    checked(spark, [(k, k - 1 if k else None) for k in range(1001)], [0, 1, 500, 1000], [1, 500])


def test_a_bush_orphans_and_loops(spark):
    rng = random.Random(3)
    bush = [(k, rng.randrange(max(0, k - 20), k) if k else None) for k in range(120)]
    odd = [(200, 999), (201, 200), (300, 301), (301, 302), (302, 300), (303, 301), (304, 303), (400, 400), (401, 400)]
    rng.shuffle(bush)
    checked(spark, bush + odd, [*range(120), 200, 201, 300, 301, 302, 303, 304, 400, 401, 7777], [5, 200, 302, 303, 400, 7777])


def test_siblings_follow_the_order(spark):
    rows = [(1, None, "b"), (2, None, "a"), (3, 1, "z"), (4, 1, "y"), (5, 4, "x"), (6, 1, "y")]
    spans = intervals.intervals(spark.createDataFrame(rows, NODES + ", name string"), ["name"])
    assert [r["id"] for r in spans.orderBy("place").collect()] == [2, 1, 4, 5, 6, 3]
    assert {r["id"]: r["depth"] for r in spans.collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 1}


def test_nothing(spark):
    none = spark.createDataFrame([], NODES)
    assert intervals.intervals(none).count() == 0 and hierarchy.subtree(none, 1).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_levels_of_a_subtree(spark, depth):
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(80)], NODES)
    assert {r["id"] for r in hierarchy.subtree(nodes, 3, depth).collect()} == set(range(3, min(80, 4 + depth)))


def test_levels_in_a_loop(spark):
    nodes = spark.createDataFrame([(k, (k + 9) % 10) for k in range(10)], NODES)
    assert {r["id"] for r in hierarchy.subtree(nodes, 8, 3).collect()} == {8, 9, 0, 1}


def test_counts_below(spark):
    rows = [(k, k // 3 if k else None) for k in range(60)]
    counts = [(k, k * k) for k in range(0, 60, 4)]
    spans = intervals.intervals(spark.createDataFrame(rows, NODES))
    found = dict(intervals.counts_below(spans, spark.createDataFrame(counts, "id long, count long")).collect())
    assert found == {k: sum(n for i, n in counts if i in below(rows, k)) for k, _ in rows}


def test_a_range_reaches_the_scan(spark, tmp_path):
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(300)], NODES)
    spans = materialize(intervals.intervals(nodes), "spans")
    images = spark.range(3000).select("id", (F.col("id") % 310).alias("folder_id"))
    intervals.placed(images, spans, "folder_id", "folder_place").write.parquet(str(tmp_path / "images"))
    found = spark.read.parquet(str(tmp_path / "images")).where(intervals.inside(spans, 250, "folder_place"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(folder_place,250)" in plan and "LessThanOrEqual(folder_place,299)" in plan and "Join" not in plan
    assert sorted(r["id"] for r in found.collect()) == [k for k in range(3000) if 250 <= k % 310 < 300]


def test_running_sum_keeps_columns_of_its_own_names(spark):
    rows = spark.createDataFrame([(k, k % 3, 1, 2, 3) for k in range(50)], "id long, v long, part int, own int, start int").repartition(4)
    found = sorted(running_sum(rows, ["id"], "v").collect())
    assert [r["before"] for r in found] == [sum(k % 3 for k in range(n)) for n in range(50)]
    assert all((r["part"], r["own"], r["start"]) == (1, 2, 3) for r in found)


def walked(rows: list[tuple]) -> dict:
    """(place, first, last, depth) by id of rows (id, parent_id, name), by a walk; loops are cut above their smallest id."""
    parent, name = {i: p for i, p, _ in rows}, {i: n for i, _, n in rows}
    loops = {}
    for i in parent:
        seen, at = [], i
        while at in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at == i:
            loops[i] = min(seen)
    above = {i: p if p in parent and loops.get(i) != i else None for i, p in parent.items()}
    key = lambda i: (name[i] is not None, name[i] or "", i)
    children: dict = {}
    for i in sorted(parent, key=key):
        children.setdefault(above[i], []).append(i)
    found, todo = {}, [(i, 0) for i in reversed(children.get(None, []))]
    while todo:
        i, depth = todo.pop()
        found[i] = [len(found), len(found), None, depth]
        todo += [(c, depth + 1) for c in reversed(children.get(i, []))]
    for i, told in found.items():
        told[2] = told[0] + len(below([(c, p) for c, p in above.items()], i)) - 1
    return {i: tuple(t if i not in loops else (t[0], *found[loops[i]][1:3], t[3])) for i, t in found.items()}


@pytest.mark.parametrize("block", [7, intervals.BLOCK])
def test_trees_that_cross_blocks(spark, block):
    rng = random.Random(block)
    ids = rng.sample(range(1000), 150)
    rows = [(i, ids[rng.randrange(max(0, k - 5), k)] if k % 40 else rng.choice([None, 5000]), rng.choice([None, "a", "b"])) for k, i in enumerate(ids)]
    rows += [(2000 + k, 2000 + (k * 13 + 1) % 20, "z") for k in range(20)] + [(2100, 2005, "c"), (2101, 2100, None), (-5, 2101, "c"), (-7, -7, "d"), (2200, -7, "e")]
    rng.shuffle(rows)
    spans = intervals.intervals(spark.createDataFrame(rows, NODES + ", name string"), ["name"], block)
    assert {r["id"]: (r["place"], r["first"], r["last"], r["depth"]) for r in spans.collect()} == walked(rows)


def test_rounds_write_only_what_leads_from_block_to_block(spark, monkeypatch):
    written = []

    def counting(df, label):
        told = materialize(df, label)
        written.append((label, told.count()))
        return told

    monkeypatch.setattr(intervals, "materialize", counting)
    spans = intervals.intervals(spark.createDataFrame([(k, k - 1 if k else None) for k in range(1000)], NODES))
    assert [r["depth"] for r in spans.orderBy("id").collect()] == list(range(1000))
    assert sum(n for label, n in written if label in ("up", "sizes", "numbers")) <= 20, written


@pytest.mark.parametrize("block", [4, intervals.BLOCK])
def test_counts_below_across_blocks_and_loops(spark, block):
    rng = random.Random(5)
    rows = [(k, rng.randrange(max(0, k - 9), k) if k % 30 else None) for k in range(90)] + [(200, 201), (201, 202), (202, 200), (203, 202), (204, 203), (300, 300), (301, 300)]
    counts = [(k, k * k) for k, _ in rows if k % 3]
    spans = intervals.intervals(spark.createDataFrame(rows, NODES))
    found = dict(intervals.counts_below(spans, spark.createDataFrame(counts, "id long, count long"), block).collect())
    assert found == {k: sum(n for i, n in counts if i in below(rows, k)) for k, _ in rows}


def test_counts_below_look_up_ends_without_a_shuffle(spark):
    spans = spark.range(3000).select("id", F.col("id").alias("place"), F.col("id").alias("first"), F.lit(2999).cast("long").alias("last"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large
    try:
        counts = intervals.counts_below(materialize(spans, "spans"), spark.range(3000).select("id", F.lit(1).cast("long").alias("count")))
        assert "hashpartitioning" not in counts._jdf.queryExecution().toString()
        assert {r["id"]: r["count"] for r in counts.collect()} == {k: 3000 - k for k in range(3000)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
