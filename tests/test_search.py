from __future__ import annotations

import json
import random
import re
import sqlite3

import pytest
from catalogs import FOLDERS, IMAGES, LINKS, small_catalog
from pyspark.sql import functions as F

from vitrine.functions.text import like_nocase, parse_rfc3339, plain_text, rfc3339_text, seconds_apart, trigram_contains
from vitrine.plans.predicate import Criterion, Group, condition, parse, to_json, whole
from vitrine.plans.search import LibraryQuery, find_folder, needs_thumbnail, suggestions, toggle_sort
from vitrine.streaming.retries import History, drain, next_batch


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark)


def ids(df) -> list[int]:
    return sorted(r.id for r in df.collect())


def found(catalog, *criteria, operator="and") -> list[int]:
    return ids(catalog.images.where(condition(Group(operator, tuple(Criterion(*c) for c in criteria)), catalog)))


EVERY = [i[0] for i in IMAGES]


@pytest.mark.parametrize(
    ("criterion", "want"),
    [
        (("filename", "contains", "DRAG"), [1, 2]),
        (("filename", "contains", "DRAGÓ"), [2]),
        (("filename", "contains", "dr"), []),
        (("filename", "contains", ""), []),
        (("filename", "contains", "r%g"), []),
        (("notes", "contains", 'z "q'), [5]),
        (("notes", "contains", "dragon"), [1]),
        (("notes", "not_contains", "dragon"), [2, 3, 4, 5, 6, 7, 8]),
        (("notes", "not_contains", "x"), EVERY),
        (("format", "contains", "P"), [1, 2, 4, 5, 6, 7, 8]),
        (("format", "contains", "_p_"), [2, 4, 5, 6]),
        (("format", "not_contains", "p"), []),
        (("format", "not_contains", "jp"), [1, 7, 8]),
        (("format", "equals", "JPEG"), [2, 5]),
        (("format", "eq", "jpe"), [5, 6]),
        (("filename", "equals", "A"), [3, 7]),
        (("filename", "eq", "a"), [3, 4, 7]),
        (("notes", "equals", ""), [4]),
        (("notes", "equals", 5), [4]),
        (("filename", "starts_with", "DRAG"), [1, 2]),
        (("filename", "ends_with", "A"), [3, 4, 5, 7, 2]),
        (("notes", "ends_with", "SURE"), [3]),
        (("notes", "starts_with", "x_y\\"), [5]),
        (("filename", "near", "a"), EVERY),
        (("size", "gt", 100), [2, 5]),
        (("size", "lte", 100.5), []),
        (("size", "gte", "100"), [1, 2, 4, 5, 6, 7, 8]),
        (("rating", "eq", True), [1, 8]),
        (("size", "between", [1, 100]), [1, 4, 6, 7, 8]),
        (("rating", "between", 7), [2, 7]),
        (("rating", "like", 7), [2, 7]),
        (("created_at", "after", "2024-01-02"), [3, 4, 5, 7, 8]),
        (("created_at", "before", "2024-01-02"), [1, 2, 6]),
        (("created_at", "on", "2024-01-01"), [1, 2, 6]),
        (("modified_at", "between", ["2024-01-01", "2024-01-05"]), []),
        (("modified_at", "between", ["2024-01-01", "2024-01-06"]), [1, 2, 6]),
        (("added_at", "between", ["2024-01-01", "2024-01-05"]), [1, 4, 5, 6]),
        (("added_at", "near", "2024-01-05"), []),
        (("tags", "contains", "2"), [1, 2, 4]),
        (("tags", "contains_any", 3), [4, 6]),
        (("tags", "not_contains", 2), [3, 5, 6, 7, 8]),
        (("tags", "contains", "two"), EVERY),
        (("tags", "contains", 2.0), EVERY),
        (("tags", "all", 2), EVERY),
        (("folder", "is", 2), [2, 3]),
        (("folder", "is", "2"), []),
        (("folder", "in", 2), [2, 3, 4, 5]),
        (("folder", "in", 8), [8]),
        (("folder", "under", 2), EVERY),
        (("colour", "is", 2), EVERY),
    ],
)
def test_criteria(catalog, criterion, want):
    assert found(catalog, criterion) == sorted(want)


@pytest.mark.parametrize(
    ("criterion", "want"),
    [
        (("created_at", "after", "2024-01-02"), [5, 7, 8]),
        (("created_at", "after", "2024-01-02 12:00:00"), [5, 7, 8]),
        (("created_at", "before", "2024-01-02"), [1, 2, 6]),
        (("added_at", "on", "2024-01-05"), [1, 4, 6]),
        (("modified_at", "between", ["2024-01-01", "2024-01-05"]), [1, 2, 6]),
        (("modified_at", "between", "2024-01-01"), []),
        (("modified_at", "before", "soon"), []),
    ],
)
def test_typed_times(catalog, criterion, want):
    tree = Group("and", (Criterion(*criterion),))
    df = catalog.images.where(condition(tree, catalog, typed_times=True))
    assert ids(df) == want


def test_filters_reach_the_scan(catalog):
    stored = catalog.materialized()
    tree = to_json(Group("and", (Criterion("size", "gt", 5), Criterion("created_at", "after", "2024-01-02"))))
    plan = LibraryQuery(advanced_query=tree, typed_times=True).count(stored)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size,5)" in plan and "GreaterThanOrEqual(created_at" in plan and "notes" not in plan.split("ReadSchema")[1]


def test_groups(catalog):
    a, b = ("rating", "gte", 3), ("format", "contains", "png")
    assert found(catalog, a, b) == [] and found(catalog, a, b, operator="or") == [1, 4, 5, 6, 7]
    assert found(catalog, operator="or") == found(catalog) == EVERY
    tree = Group("or", (Group("and", (Criterion(*a), Criterion("tags", "contains", 3))), Criterion("notes", "equals", "no")))
    assert ids(catalog.images.where(condition(tree, catalog))) == [4, 6, 8]
    assert found(catalog, ("notes", "near", 1), ("rating", "eq", 9), operator="or") == EVERY


def test_parse():
    tree = Group("and", (Criterion("a", "b", [1, "x", None]), Group("or", ())))
    assert parse(to_json(tree)) == tree
    good = {"id": "1", "logicalOperator": "and", "items": [{"id": "2", "key": "k", "operator": "o", "value": None, "displayValue": "more"}], "extra": 1}
    assert parse(json.dumps(good)) == Group("and", (Criterion("k", "o", None),))
    for bad in (None, "", "[", "[]", "null", "5", '{"id":"1","items":[]}', json.dumps(good | {"logicalOperator": "xor"}), json.dumps(good | {"items": [{"id": "2", "key": "k", "operator": "o"}]}), json.dumps(good | {"id": 1})):
        assert parse(bad) is None
    assert [whole(x) for x in (5, -1, 2.5, "5", True, None, 2**63, [1])] == [5, -1, 0, 0, 0, 0, 0, 0]


def test_parameters(catalog):
    q = lambda **kw: ids(LibraryQuery(**kw).matching(catalog))
    assert q(search_query="DRAG") == [1, 2, 6] and q(search_query="") == EVERY and q(search_query="a%n") == [1, 2, 5, 7]
    assert q(folder_id=2) == [2, 3] and q(folder_id=2, recursive=True) == [2, 3, 4, 5] and q(folder_id=77, recursive=True) == []
    assert q(untagged=True) == [3, 5, 7, 8] and q(untagged=True, tag_ids=(1,)) == []
    assert q(tag_ids=(1, 3)) == [1, 4, 6] and q(tag_ids=(1, 3), match_all=True) == [4] and q(tag_ids=(1, 1), match_all=True) == []
    assert q(advanced_query="{bad", folder_id=6) == [6]
    assert LibraryQuery(tag_ids=(2,)).count(catalog).first()["count"] == 3


def listed(catalog, **kw) -> list[int]:
    return [r.id for r in LibraryQuery(**kw).to_df(catalog).collect()]


def test_order_and_pages(catalog):
    assert listed(catalog, sort_by="size", sort_order="asc") == [4, 7, 8, 6, 1, 2, 5, 3]
    assert listed(catalog, sort_by="size", sort_order="desc")[-1] == 3 and listed(catalog, sort_by="added_at", sort_order="asc")[-1] == 3
    assert listed(catalog, sort_by="filename", sort_order="asc") == [4, 7, 3, 6, 5, 1, 2, 8]
    assert listed(catalog, sort_by="path", sort_order="asc") == EVERY and listed(catalog, sort_by="rating", sort_order="x", limit=1) == [6]
    everything = listed(catalog, sort_by="format", sort_order="asc")
    assert [i for k in range(0, 9, 3) for i in listed(catalog, sort_by="format", sort_order="asc", limit=3, offset=k)] == everything
    assert listed(catalog, limit=0) == [] and listed(catalog, limit=-3, offset=-9) == sorted(EVERY, reverse=True)
    assert toggle_sort("size", "desc", "size") == ("size", "asc") and toggle_sort("size", "asc", "name") == ("name", "desc")


def test_plans_sort_no_more_than_the_page(catalog):
    plan = LibraryQuery(sort_by="size", limit=5, offset=5).to_df(catalog)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_like_is_sqlites(spark):
    rng = random.Random(3)
    values = ["".join(rng.choices("aAbB%_\\éÉ.", k=rng.randint(0, 6))) for _ in range(60)] + [None]
    patterns = ["".join(rng.choices("aAbB%_\\éÉ.", k=rng.randint(0, 4))) for _ in range(40)]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    got = df.select("v", *(like_nocase(F.col("v"), p).alias(f"p{k}") for k, p in enumerate(patterns))).collect()
    for row in got:
        for k, p in enumerate(patterns):
            want = con.execute("SELECT ? LIKE ?", (row.v, p)).fetchone()[0]
            assert row[f"p{k}"] == (None if want is None else bool(want)), (row.v, p)


def test_trigrams_are_sqlites(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(v, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no trigram index")
    rng = random.Random(4)
    values = ["".join(rng.choices("aAbBÓó%_", k=rng.randint(0, 9))) for _ in range(80)]
    con.executemany("INSERT INTO f(rowid, v) VALUES (?, ?)", enumerate(values, 1))
    df = spark.createDataFrame(list(enumerate(values, 1)), "id long, v string").coalesce(1).cache()
    for p in ["".join(rng.choices("aAbBÓó%_", k=rng.randint(1, 4))) for _ in range(25)]:
        want = sorted(r[0] for r in con.execute("SELECT rowid FROM f WHERE v MATCH ?", (f'"{p}"',)))
        assert ids(df.where(trigram_contains(F.col("v"), p))) == want, p


def test_time_texts(spark):
    df = spark.sql("SELECT timestamp '2024-01-05 10:00:00' AS a, timestamp '2024-01-05 10:00:00.5' AS b, timestamp '2024-01-05 10:00:00.000001' AS c")
    r = df.select(*(rfc3339_text(F.col(c)).alias(c) for c in "abc"), plain_text(F.col("b")).alias("p"), seconds_apart(F.col("a"), F.col("b")).alias("s"), parse_rfc3339(F.lit("2024-01-05T10:00:00+00:00"), F.col("b")).alias("t"), parse_rfc3339(F.lit("bad"), F.col("b")).alias("u"), F.col("b").alias("had")).first()
    assert (r.a, r.b, r.c) == ("2024-01-05T10:00:00+00:00", "2024-01-05T10:00:00.500+00:00", "2024-01-05T10:00:00.000001+00:00")
    assert r.p == "2024-01-05 10:00:00" and r.s == 0 and r.u == r.had and re.match("2024-01-05 10:00:00$", str(r.t))


def test_lookups(spark, catalog):
    assert [r.id for r in find_folder(catalog.folders, "/A/B").collect()] == [2]
    assert [r.id for r in find_folder(catalog.folders, "/A/empty").collect()] == [7]
    assert find_folder(catalog.folders, "/no").count() == 0
    assert [r.name for r in suggestions(catalog.tags.select("name"), "AG", catalog.tags.where("id = 9")).collect()] == ["Dragons"]
    assert ids(needs_thumbnail(catalog.images, 99)) == [1, 5] and needs_thumbnail(catalog.images, 99, []).count() == 0
    assert ids(needs_thumbnail(catalog.images, 99, [5, 3])) == [5] and needs_thumbnail(catalog.images, 1).count() == 1


def test_retries(spark, catalog):
    left = {r.id: r.thumbnail_attempts for r in catalog.images.where("thumbnail_path IS NULL").collect()}

    def read():
        return spark.createDataFrame([(i, f"/{i}", None, n) for i, n in left.items()], "id long, path string, thumbnail_path string, thumbnail_attempts int")

    assert [r.id for r in next_batch(read(), priority=[5, 99], size=2).collect()] == [5, 1]

    def work(batch):
        for r in batch.collect():
            left[r.id] += 1

    assert drain(read, work) == 2 and set(left.values()) == {3}


def test_history():
    h = History(most=3)
    assert h.undo() is None
    for q in "aabcd":
        h.push(q)
    assert h.items == ["b", "c", "d"] and h.undo() == "c" and h.undo() == "b" and h.undo() == "b" and h.redo() == "c"
    h.push("x")
    assert h.items == ["b", "c", "x"] and h.redo() == "x"


def test_fixture_has_every_folder_kind():
    assert {f[1] for f in FOLDERS} >= {None, 99} and {t for _, t in LINKS} == {1, 2, 3}
