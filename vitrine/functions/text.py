"""Text matching with the catalog's rules: ASCII-only folding, wildcards without escape, trigram search, timestamps as text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; other letters stay as they are."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def ascii_fold(text: str) -> str:
    return text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def like_nocase(text: Column, pattern: str) -> Column:
    """LIKE that folds ASCII case; % and _ are wildcards and nothing escapes them. Null stays null, under NOT too."""
    return ascii_lower(text).like(ascii_fold(pattern).replace("\\", "\\\\"))


def equals_nocase(text: Column, value: str) -> Column:
    return ascii_lower(text) == ascii_fold(value)


def trigram_contains(text: Column, value: str) -> Column:
    """Whether `value` is in `text`, folding all letters' case; never null.

    As in a trigram index, a value of fewer than 3 characters is found nowhere, and wildcards are plain characters.
    """
    if len(value) < 3:
        return F.lit(False)
    return F.coalesce(F.lower(text).contains(value.lower()), F.lit(False))


def rfc3339_text(at: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS[.fff[fff]]+00:00, the text of created and modified times."""
    micros = F.unix_micros(at.cast("timestamp")) % 1_000_000
    fraction = F.when(micros == 0, "").when(micros % 1000 == 0, F.date_format(at, ".SSS")).otherwise(F.date_format(at, ".SSSSSS"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def plain_text(at: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS, the text of times that the database sets."""
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")


def parse_rfc3339(text: Column, otherwise: Column | None = None) -> Column:
    """The timestamp that `text` tells, or `otherwise` (now) where it tells none."""
    return F.coalesce(F.try_to_timestamp(text), F.current_timestamp() if otherwise is None else otherwise)


def seconds_apart(a: Column, b: Column) -> Column:
    """Whole seconds between two timestamps, without sign."""
    return F.floor(F.abs(F.unix_micros(a) - F.unix_micros(b)) / 1_000_000)
