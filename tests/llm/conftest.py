"""Documents that hold every case the operators must handle."""

from __future__ import annotations

import random

import pytest

WORDS = "the of and river stone quickly Maria house 42 km blue garden window letter seven under walks königin été niño".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    long = prose(rng, 30_000)
    lines = ["  Shared LINE \t", "shared line", "other line", ""]
    odd = [None, "", " ", "\n", "\n\n", "a", "...", "12 34", "\x1c\x85 x", "ÄÖÜ äöü", "İ ﬁ ſ", "<|endoftext|> a", "tab\tand\x0bvt", "😀 emoji 👩‍👩‍👧 joined", "a" * 5000, "1" * 3000]
    shared = ["\n".join([prose(rng, 8), *rng.sample(lines, 3), prose(rng, 5)]) for _ in range(15)]
    return [*base, *base[:10], *([base[0]] * 12), long, *odd, *odd, *shared]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Ids in no order, one null, two rows alike, and columns with names that operators use."""
    rows = [(k * 7 % 1009, t, k % 5, "x") for k, t in enumerate(texts)]
    rows += [(None, "no id here", 0, "x"), (2000, "twice", 1, "y"), (2000, "twice", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, fp int, key string").repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, fp int, key string")
