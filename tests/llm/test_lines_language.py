from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vitrine.llm import langid
from vitrine.llm.linededup import dedup_lines, filter_size

STRIP = " \t\n\x0b\x0c\r"


def key_of(line: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(STRIP))


def brute_lines(rows, min_docs, min_chars, keep):
    found = Counter()
    first = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        for k in {key_of(x) for x in lines}:
            found[k] += 1
            at = (doc is not None, doc or 0, next(n for n, x in enumerate(lines) if key_of(x) == k))
            first[k] = min(first.get(k, at), at)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for n, x in enumerate(lines):
            k = key_of(x)
            gone = len(k) >= max(min_chars, 1) and found[k] >= min_docs and not (keep == "first" and first[k] == (doc is not None, doc or 0, n))
            if not gone:
                kept.append(x)
        out.append((doc is not None, doc or 0, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("min_docs", "min_chars", "filter_bits", "broadcast"), [(10, 1, 1 << 29, 1 << 25), (2, 3, 1 << 19, 1 << 25), (2, 1, 1 << 29, 0)])
def test_lines_match_brute_force(docs, keep, min_docs, min_chars, filter_bits, broadcast):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = dedup_lines(docs, min_docs, min_chars, keep, broadcast_bytes=broadcast, filter_bits=filter_bits)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows, min_docs, min_chars, keep)


def test_full_filters_change_nothing(spark):
    """Far more lines than the smallest filter has bits for: suspicions grow, results don't."""
    rng = random.Random(0)
    rows = [(k, "\n".join(f"line {rng.randrange(60_000)}" for _ in range(700))) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = dedup_lines(df, min_docs=3, filter_bits=1 << 19)
    assert sorted((True, r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(rows, 3, 1, "none")


def test_lines_of_nothing(none):
    assert dedup_lines(none).count() == 0
    assert filter_size(0) <= filter_size(10**9) <= 1 << 29


LANGUAGES = {"aa": "the quick house of and that", "bb": "der schnelle haus und daß über", "cc": "la casa rápida y que niño"}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for k in range(300):
        lang = rng.choice(list(LANGUAGES))
        rows.append((k, " ".join(rng.choices(LANGUAGES[lang].split(), k=rng.randint(3, 40))), lang if k % 17 else None))
    rows += [(1000, None, "aa"), (1001, "12 ... 34", "bb"), (1002, "", "cc")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_held_out_is_crc(labelled):
    got = {r.doc_id: r.h for r in labelled.select("doc_id", langid.held_out().alias("h")).collect()}
    assert got == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in got}


def test_language_on_held_out_rows(labelled):
    model = langid.fit(labelled.where(~langid.held_out()))
    assert model.languages == ("aa", "bb", "cc")
    told = langid.predict(labelled.withColumn("h", langid.held_out()), model).collect()
    held = [r for r in told if r.h and r.lang]
    right = sum(r.lang_pred == r.lang for r in held if r.doc_id < 1000) / sum(r.doc_id < 1000 for r in held)
    assert right >= 0.97
    by = {r.doc_id: r for r in told}
    for d in (1000, 1001, 1002):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in told)


def test_letters():
    assert all(map(langid.has_letter, ("a", "1é", "  中", "ª", "ÿ"))) and not any(map(langid.has_letter, ("", "12 _-", "²½Ⅷ", "😀", "\u0301")))


def test_scores_are_multinomial(labelled):
    """Against the sum over n-grams by hand, text by text; batches and pieces change nothing."""
    import numpy as np

    model = langid.fit(labelled)
    texts = [b"the haus rapida", b"x", b"", " über daß  niño".encode(), b"a" * 50]
    got = model.scores(texts)
    for t, row in zip(texts, got, strict=True):
        x = langid.fold(t)
        want = sum((table[langid.grams(x, n)].sum(0) for table, n in zip(model.log_p, langid.SIZES, strict=True)), np.zeros(3))
        assert np.allclose(row, want, atol=1e-3)


def test_long_texts_count_whole(spark, labelled):
    """Another language that begins after the first piece wins if it has more text."""
    model = langid.fit(labelled)
    rng = random.Random(2)
    a = " ".join(rng.choices(LANGUAGES["aa"].split(), k=30_000))
    b = " ".join(rng.choices(LANGUAGES["bb"].split(), k=400_000))
    df = spark.createDataFrame([(1, a + " " + b), (2, b[:1000] + " " + a)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {1: "bb", 2: "aa"}


def test_no_labels(none, docs):
    from pyspark.sql import functions as F

    model = langid.fit(none.withColumn("lang", F.lit(None).cast("string")))
    told = langid.predict(docs.withColumn("score", F.lit("clash")), model)
    assert {r.lang_pred for r in told.collect()} == {"und"} and dict(told.dtypes)["score"] == "double"


def test_a_bounded_sample_still_tells(labelled):
    model = langid.fit(labelled, train_rows=60)
    told = langid.predict(labelled, model).where("lang IS NOT NULL AND doc_id < 1000").collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.95 * len(told)


def test_fit_counts_what_plain_python_counts(spark):
    """The fitted table against n-grams counted by hand from the text, without the module's own folding, hashing or sums."""
    rows = [("en", "The river, THE stone!"), ("de", "Der Fluß 42 und  das"), ("en", "a house"), ("de", "über"), ("fr", None), (None, "the"), ("fr", "12 34"), ("fr", "où est\n\tl'été")]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string").repartition(3))
    languages = ("de", "en", "fr")
    assert model.languages == languages
    counts = {(n, lang): {} for n in (2, 3, 4) for lang in languages}
    docs = dict.fromkeys(languages, 0)
    for lang, text in rows:
        if not lang or not text or not any(c.isalpha() for c in text):
            continue
        docs[lang] += 1
        raw = re.sub(rb"[\x00-@\[-`{-\x7f]+", b" ", b" " + text.encode() + b" ").lower()
        for n in (2, 3, 4):
            for k in range(len(raw) - n + 1):
                bucket = (int.from_bytes(raw[k : k + n], "little") * 2654435761 % 2**32) // 2**16
                own = counts[n, lang]
                own[bucket] = own.get(bucket, 0) + 1
    for at, n in enumerate((2, 3, 4)):
        total = {lang: sum(counts[n, lang].values()) + 0.5 * 2**16 for lang in languages}
        for bucket in {b for lang in languages for b in counts[n, lang]} | {0, 77}:
            p = [math.log((counts[n, lang].get(bucket, 0) + 0.5) / total[lang]) for lang in languages]
            want = [x - sum(p) / 3 for x in p]
            assert np.allclose(model.log_p[at, bucket], want, atol=1e-5)
    assert np.allclose(model.prior, [math.log((docs[lang] + 1) / (sum(docs.values()) + 3)) for lang in languages])


def test_texts_of_languages_that_were_not_learned_are_not_typical(spark):
    """The posterior weighs learned languages only; how likely a text is in the one that wins tells others apart."""
    rng = random.Random(12)
    syllables = {"aa": "the of an er in on at ing ed re ou ha".split(), "bb": "der die en ge ver ich ung sch ein lich zu ber".split()}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3)))
    prose = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = [(k, prose(lang, rng.randint(3, 200)), lang) for k, lang in enumerate(["aa", "bb"] * 150)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(labelled.where("doc_id < 200"), typical=True)
    asked = rows[200:] + [(1000, "Это русское предложение, которого модель не видела", None), (1001, "qzxv kjwq zzxq vvkq xqzj", None), (1002, None, None), (1003, "12 !!", None), (1004, prose("aa", 60_000), None)]
    told = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string, typical string"), model, typical_col="typical").collect()}
    assert all(told[k].typical and told[k].lang_pred == lang for k, _, lang in rows[200:]) and told[1004].typical
    assert not any(told[k].typical for k in (1000, 1001, 1002, 1003)) and told[1000].lang_pred in ("aa", "bb")
    assert all(r.typical for r in langid.predict(labelled, langid.fit(labelled), typical_col="typical").collect())
    assert langid.fit(labelled.where("false"), typical=True).languages == ()
