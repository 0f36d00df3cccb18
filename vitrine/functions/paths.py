"""Paths with `/`: parts, ancestors and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Without slashes at the end; nothing left is the root."""
    cut = F.rtrim(path, F.lit("/"))
    return F.when(cut == "", "/").otherwise(cut)


def parent(path: Column) -> Column:
    """The folder that holds `path`; the root for its children, null for the root itself and for bare names."""
    own = normalize(path)
    above = F.substring_index(own, "/", -1)
    held = F.substr(own, F.lit(1), F.char_length(own) - F.char_length(above) - 1)
    return F.when((own == "/") | ~own.contains("/"), None).when(held == "", "/").otherwise(held)


def basename(path: Column) -> Column:
    return F.substring_index(normalize(path), "/", -1)


def extension(path: Column) -> Column:
    """The lower-cased extension, or null: names that begin with their only dot, or have none, have none."""
    found = F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1)
    return F.when(found != "", F.lower(found))


def ancestors(path: Column) -> Column:
    """Every folder on the way to `path`, itself included, from the top: array of paths."""
    own = F.rtrim(path, F.lit("/"))
    parts = F.filter(F.split(own, "/"), lambda p: p != "")
    lead = F.when(own.startswith("/"), "/").otherwise("")
    some = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    return F.transform(some, lambda n: F.concat(lead, F.array_join(F.slice(parts, F.lit(1), n), "/")))


def is_under(path: Column, root: str) -> Column:
    """Whether `path` is `root` or below it. `/a/bc` is not below `/a/b`; no character is a wildcard."""
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def replace_prefix(path: Column, old: str, new: str) -> Column:
    """`path` with `old` at its head exchanged for `new`, if it is `old` or below it."""
    old, new = old.rstrip("/"), new.rstrip("/")
    return F.when(is_under(path, old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(path)
