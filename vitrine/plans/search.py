"""Searches over the catalog: filters, order and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import ascii_lower, equals_nocase, like_nocase
from vitrine.operators.hierarchy import subtree
from vitrine.operators.numbering import numbered
from vitrine.plans.predicate import condition, parse
from vitrine.sources.catalog import RESULT, Catalog

#: Columns that a search may sort by; any other name sorts by id.
SORTABLE = ("filename", "created_at", "modified_at", "added_at", "size", "format", "rating")
#: Rows of a page, and how the first one is sorted.
PAGE, SORT = 100, ("modified_at", "desc")
#: Pages that end within so many rows are sorted as the best rows of each task, which meet in one; others are told by the places of their ends.
ONE_TASK = 1_000


#: Where a page ends: the values of the sort's keys in its last row.
Cursor = tuple


@dataclass(frozen=True)
class LibraryQuery:
    """A search. limit and offset page the sorted rows; a negative limit is none, a negative offset is 0. typed_times: see condition()."""

    tag_ids: tuple[int, ...] = ()
    match_all: bool = False
    untagged: bool = False
    folder_id: int | None = None
    recursive: bool = False
    sort_by: str | None = None
    sort_order: str | None = None
    advanced_query: str | None = None
    search_query: str | None = None
    limit: int = -1
    offset: int = 0
    typed_times: bool = False

    def matching(self, catalog: Catalog) -> DataFrame:
        """The images that match, all columns, in no order. Each is in the result once."""
        found = catalog.images
        tree = parse(self.advanced_query)
        if tree:
            found = found.where(condition(tree, catalog, self.typed_times))
        if self.search_query:
            pattern = f"%{self.search_query}%"
            found = found.where(like_nocase(F.col("filename"), pattern) | like_nocase(F.col("notes"), pattern))
        if self.folder_id is not None:
            if self.recursive:
                below = subtree(catalog.folders, self.folder_id).select(F.col("id").alias("folder_id"))
                found = found.join(below, "folder_id", "left_semi")
            else:
                found = found.where(F.col("folder_id") == self.folder_id)
        if self.untagged:
            found = found.join(catalog.image_tags.select(F.col("image_id").alias("id")), "id", "left_anti")
        if self.tag_ids:
            tagged = catalog.image_tags.where(F.col("tag_id").isin(*self.tag_ids)).select(F.col("image_id").alias("id"), "tag_id")
            if self.match_all:
                held = tagged.groupBy("id").agg(F.count_distinct("tag_id").alias("n"))
                tagged = held.where(F.col("n") == len(self.tag_ids))  # a tag asked for twice is never held twice
            found = found.join(tagged.select("id"), "id", "left_semi")
        return found

    def order(self) -> list[Column]:
        """Nulls last either way; names sort without ASCII case, ties by name and then by id."""
        by = self.sort_by if self.sort_by in SORTABLE else "id"
        key = ascii_lower(F.col(by)) if by in ("filename", "format") else F.col(by)
        first = key.asc_nulls_last() if self.sort_order == "asc" else key.desc_nulls_last()
        ties = [] if by == "filename" else [ascii_lower(F.col("filename")).asc()]
        return [first, *ties, F.col("id").asc()]

    def to_df(self, catalog: Catalog) -> DataFrame:
        """The page of matching images, sorted, with a search's columns."""
        return self._cut(self.matching(catalog), max(self.offset, 0))

    def _cut(self, found: DataFrame, skip: int) -> DataFrame:
        """Of the sorted rows of `found` the first `limit` after `skip`, with a search's columns.

        A page that ends far from the start, or has no end, would pass through one task. There the keys alone are sorted in ranges and numbered, and the page is the rows between its ends' places. Ids must differ.
        """
        end = skip + self.limit
        if self.limit < 0 and skip == 0 or self.limit >= 0 and end <= ONE_TASK:
            page = found.select(*RESULT).orderBy(*self.order())
            page = page.offset(skip) if skip else page
            return page.limit(self.limit) if self.limit >= 0 else page
        keys = [f"key_{n}" for n in range(len(self._keys()))]
        first, *ties = keys
        order = [F.col(first).asc_nulls_last() if self.sort_order == "asc" else F.col(first).desc_nulls_last(), *(F.col(key).asc() for key in ties)]
        placed = numbered(found.select(*(key.alias(name) for name, (key, _) in zip(keys, self._keys(), strict=True))), order)
        ends = {place: tuple(key) for *key, place in placed.where(F.col("place").isin(skip - 1, end - 1)).select(*keys, "place").collect()}  # two rows at most
        if skip:
            found = found.where(self._beyond(ends[skip - 1]) if skip - 1 in ends else F.lit(False))
        if self.limit >= 0 and end - 1 in ends:
            found = found.where(~self._beyond(ends[end - 1]))
        return found.select(*RESULT).orderBy(*self.order())

    def page_after(self, catalog: Catalog, cursor: Cursor | None = None) -> DataFrame:
        """The first `limit` rows of the sorted matches that come after `cursor`, the place of an earlier page's last row (see cursor()); without one, the first page.

        The place is a filter on the sort's keys, which reaches the scan, so a later page costs what the first one does; offset plays no part.
        """
        found = self.matching(catalog)
        if cursor is not None:
            found = found.where(self._beyond(cursor))
        return self._cut(found, 0)

    def cursor(self, page: DataFrame) -> Cursor | None:
        """The place of the last row of `page` (of page_after()), for the next one; None if the page is empty and so the last."""
        (first, up), *ties = self._keys()
        turned = [first.desc_nulls_first() if up else first.asc_nulls_first(), *(key.desc_nulls_last() for key, _ in ties)]
        last = page.orderBy(*turned).select(*(key.alias(f"key_{n}") for n, (key, _) in enumerate(self._keys()))).first()
        return None if last is None else tuple(last)

    def _keys(self) -> list[tuple[Column, bool]]:
        """The columns of order(), and whether each goes up."""
        by = self.sort_by if self.sort_by in SORTABLE else "id"
        key = ascii_lower(F.col(by)) if by in ("filename", "format") else F.col(by)
        ties = [] if by == "filename" else [(ascii_lower(F.col("filename")), True)]
        return [(key, self.sort_order == "asc"), *ties, (F.col("id"), True)]

    def _beyond(self, cursor: Cursor) -> Column:
        """Whether a row comes after the place: by the first key in which they differ."""
        beyond = F.lit(False)
        for n, ((key, up), value) in reversed(list(enumerate(zip(self._keys(), cursor, strict=True)))):
            # the first key has nulls last, the others, which go up, have them first
            if value is None:
                beyond = key.isNull() & beyond if n == 0 else key.isNotNull() | (key.isNull() & beyond)
            else:
                later = (key > value) if up else (key < value)
                beyond = later | (key.isNull() if n == 0 else F.lit(False)) | ((key == value) & beyond)
        return F.coalesce(beyond, F.lit(False))

    @classmethod
    def listed(cls, **params: object) -> LibraryQuery:
        """A search as a library first shows it: sorted by SORT, PAGE rows, unless told otherwise."""
        return cls(**{"sort_by": SORT[0], "sort_order": SORT[1], "limit": PAGE, **params})

    def count(self, catalog: Catalog) -> DataFrame:
        """(count): how many images match."""
        return self.matching(catalog).agg(F.count(F.lit(1)).alias("count"))


def find_folder(folders: DataFrame, path: str) -> DataFrame:
    """The folder at `path`, or those whose path differs in ASCII case alone if there is none."""
    near = folders.where(equals_nocase(F.col("path"), path)).withColumn("exact", F.col("path") == path)
    best = near.agg(F.bool_or("exact").alias("any_exact"))
    return near.join(F.broadcast(best), F.col("exact") == F.col("any_exact"), "left_semi").drop("exact")  # best is one row


def listed_after(listed: DataFrame, removed: DataFrame, page: DataFrame) -> DataFrame:
    """A list of images that is shown, without the ids in `removed` (id), and with the rows of a further `page` that it doesn't have yet; a row that the page has too stays as it is listed."""
    kept = listed.join(removed.select("id"), "id", "left_anti").select(listed.columns)
    more = page.join(removed.select("id"), "id", "left_anti").join(listed.select("id"), "id", "left_anti")
    return kept.unionByName(more.select(listed.columns))


def suggestions(names: DataFrame, text: str, chosen: DataFrame, name_col: str = "name") -> DataFrame:
    """Names that contain `text` in any case and aren't in `chosen`."""
    return names.where(F.lower(name_col).contains(text.lower())).join(chosen.select(name_col), name_col, "left_anti")


def needs_thumbnail(images: DataFrame, limit: int, ids: list[int] | None = None, attempts: int = 3) -> DataFrame:
    """(id, path) of up to `limit` images without a thumbnail that were tried under `attempts` times; with `ids`, only of those (none: none)."""
    wanted = images.where(F.col("thumbnail_path").isNull() & (F.col("thumbnail_attempts") < attempts))
    if ids is not None:
        wanted = wanted.where(F.col("id").isin(*ids) if ids else F.lit(False))
    return wanted.select("id", "path").limit(limit)


def toggle_sort(by: str, order: str, clicked: str) -> tuple[str, str]:
    """What a search sorts by after a click on a column: the same one turns round, another starts descending."""
    return (clicked, "asc" if order == "desc" else "desc") if clicked == by else (clicked, "desc")
