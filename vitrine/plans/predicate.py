"""Search predicates: a JSON tree of criteria becomes one boolean column."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import like_nocase, plain_text, rfc3339_text, trigram_contains
from vitrine.operators.hierarchy import DEPTH, subtree
from vitrine.sources.catalog import Catalog




@dataclass(frozen=True)
class Criterion:
    key: str
    operator: str
    value: Any


@dataclass(frozen=True)
class Group:
    """Criteria and groups joined by `and` or `or`; an empty group holds for every row."""

    operator: str
    items: tuple[Criterion | Group, ...]


def parse(text: str | None) -> Group | None:
    """The tree that `text` tells, or None if it isn't one: then a search goes on without it.

    A group needs id, logicalOperator and items, a criterion id, key, operator and value; more fields do no harm.
    """
    try:
        return _group(json.loads(text or ""))
    except (ValueError, TypeError, KeyError):
        return None


def _text(x: Any) -> str:
    if not isinstance(x, str):
        raise TypeError
    return x


def _group(x: dict) -> Group:
    _text(x["id"])
    if x["logicalOperator"] not in ("and", "or") or not isinstance(x["items"], list):
        raise ValueError
    return Group(x["logicalOperator"], tuple(map(_item, x["items"])))


def _item(x: dict) -> Criterion | Group:
    try:
        return _group(x)
    except (ValueError, TypeError, KeyError):
        _text(x["id"])
        return Criterion(_text(x["key"]), _text(x["operator"]), x["value"])


def to_json(group: Group) -> str:
    """The tree as text with running ids; parse() reads it back."""
    count = iter(range(1_000_000_000))

    def told(x: Criterion | Group) -> dict:
        own = str(next(count))
        if isinstance(x, Group):
            return {"id": own, "logicalOperator": x.operator, "items": [told(i) for i in x.items]}
        return {"id": own, "key": x.key, "operator": x.operator, "value": x.value}

    return json.dumps(told(group), separators=(",", ":"), ensure_ascii=False)


def whole(value: Any) -> int:
    """The value if it is a whole number of 64 bits, else 0: 2.5, "5" and true count as 0."""
    return value if type(value) is int and -(2**63) <= value < 2**63 else 0


def _pair(value: Any) -> tuple[Any, Any] | None:
    return tuple(value) if isinstance(value, list) and len(value) == 2 else None


def _on_text(key: str, operator: str, value: Any) -> Column:
    text, v = F.col(key), value if isinstance(value, str) else ""
    indexed = key != "format"
    match operator:
        case "contains":
            return trigram_contains(text, v) if indexed else like_nocase(text, f"%{v}%")
        case "not_contains":
            return ~(trigram_contains(text, v) if indexed else like_nocase(text, f"%{v}%"))
        case "equals" | "eq" if key == "format":
            low = v.lower()
            return text.isin("jpg", "jpeg") if low in ("jpg", "jpeg") else like_nocase(text, f"%{low}%")
        case "equals" | "eq" if key == "filename":
            return (text == v) | like_nocase(text, f"{v}.%")
        case "equals" | "eq":
            return text == v
        case "starts_with":
            return like_nocase(text, f"{v}%")
        case "ends_with" if key == "filename":
            return like_nocase(text, f"%{v}") | like_nocase(text, f"%{v}.%")
        case "ends_with":
            return like_nocase(text, f"%{v}")
    return F.lit(True)


def _on_number(key: str, operator: str, value: Any) -> Column:
    number, v = F.col(key), whole(value)
    match operator:
        case "gt":
            return number > v
        case "lt":
            return number < v
        case "eq":
            return number == v
        case "gte":
            return number >= v
        case "lte":
            return number <= v
        case "between" if pair := _pair(value):
            return number.between(*map(whole, pair))
    return number == 1


def _on_time(key: str, operator: str, value: Any) -> Column:
    """Times compare as text, so the last day of a range is left out where the text has a T between day and hour."""
    at = plain_text(F.col(key)) if key == "added_at" else rfc3339_text(F.col(key))
    v = value if isinstance(value, str) else ""
    match operator:
        case "before":
            return at < v
        case "after":
            return at > v
        case "on":
            return like_nocase(at, f"{v}%")
        case "between" if pair := _pair(value):
            first, last = (x if isinstance(x, str) else "" for x in pair)
            return at.between(first, f"{last} 23:59:59" if len(last.encode()) == 10 else last)
    return at == "1"


def _on_typed_time(key: str, operator: str, value: Any) -> Column:
    """Times compare as times: a bare day means all of it, so `after` starts with the next day and ranges hold their last day. Reaches the scan."""
    at = F.col(key)

    def span(x: Any) -> tuple[Column, Column]:
        text = x if isinstance(x, str) else ""
        first = F.try_to_timestamp(F.lit(text))
        return first, first + F.expr("INTERVAL 1 DAY" if len(text) == 10 else "INTERVAL 1 MICROSECOND")

    match operator:
        case "before":
            return at < span(value)[0]
        case "after":
            return at >= span(value)[1]
        case "on":
            first, end = span(value)
            return (at >= first) & (at < end)
        case "between" if pair := _pair(value):
            return (at >= span(pair[0])[0]) & (at < span(pair[1])[1])
    return F.lit(False)


def _on_tags(catalog: Catalog, operator: str, value: Any) -> Column:
    if isinstance(value, str):
        digits = value[1:] if value[:1] in ("+", "-") else value
        tag = int(value) if digits.isascii() and digits.isdigit() else None
    else:
        tag = value if type(value) is int else None
    if tag is None or operator not in ("contains", "contains_any", "not_contains"):
        return F.lit(True)
    tagged = catalog.image_tags.where(F.col("tag_id") == tag).select("image_id")
    held = F.coalesce(F.col("id").isin(tagged), F.lit(False))
    return ~held if operator == "not_contains" else held


def _on_folder(catalog: Catalog, operator: str, value: Any) -> Column:
    match operator:
        case "is":
            return F.col("folder_id") == whole(value)
        case "in":
            return F.coalesce(F.col("folder_id").isin(subtree(catalog.folders, whole(value), depth=DEPTH)), F.lit(False))
    return F.lit(True)


def condition(tree: Group | Criterion, catalog: Catalog, typed_times: bool = False) -> Column:
    """The tree as a column over the catalog's images. Unknown keys, and unknown operators on text, tags and folders, hold for every row.

    Times compare as text, or with `typed_times` as times.
    """
    if isinstance(tree, Criterion):
        if tree.key in ("filename", "notes", "format"):
            return _on_text(tree.key, tree.operator, tree.value)
        if tree.key in ("size", "width", "height", "rating"):
            return _on_number(tree.key, tree.operator, tree.value)
        if tree.key in ("added_at", "created_at", "modified_at"):
            return (_on_typed_time if typed_times else _on_time)(tree.key, tree.operator, tree.value)
        if tree.key == "tags":
            return _on_tags(catalog, tree.operator, tree.value)
        if tree.key == "folder":
            return _on_folder(catalog, tree.operator, tree.value)
        return F.lit(True)
    parts = [condition(x, catalog, typed_times) for x in tree.items]
    if not parts:
        return F.lit(True)
    found = parts[0]
    for part in parts[1:]:
        found = found & part if tree.operator == "and" else found | part
    return found
