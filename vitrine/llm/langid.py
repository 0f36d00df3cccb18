"""Language identification: multinomial naive Bayes over hashed byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.workers import tidy

#: Sizes of the n-grams, in bytes of UTF-8 with ASCII letters lower-cased and other ASCII characters as one space.
SIZES = (2, 3, 4)
#: Buckets that the n-grams are hashed into: 2^16 for each size.
BUCKET_BITS = 16
#: The fit takes a hash sample of about this many labelled rows, or all if there are fewer.
TRAIN_ROWS = 30_000
#: Bytes of text that a task scores at a time; a longer text is scored in pieces that overlap.
BATCH_BYTES = 1 << 20
#: How far below the least likely labelled text of a language, as a share of its mean log-probability an n-gram, a text may lie and still count as typical of it.
SLACK = 0.1
#: The prediction for texts without a letter.
UNKNOWN = "und"

_ascii_letter = re.compile("[A-Za-z]").search

# every ASCII byte but letters becomes a space, letters are lower-cased, bytes of other characters stay
_FOLD = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))


def has_letter(text: str) -> bool:
    return bool(_ascii_letter(text)) or any(map(str.isalpha, text))


def fold(text: bytes) -> np.ndarray:
    """Folded bytes with runs of spaces as one, and a space at either end."""
    x = np.frombuffer((b" " + text + b" ").translate(_FOLD), np.uint8)
    space = x == 32
    kept = np.ones(len(x), bool)
    np.logical_and(space[1:], space[:-1], out=kept[1:])
    np.logical_not(kept[1:], out=kept[1:])
    return x[kept]


def grams(text: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each of `text`'s folded bytes but the last `size` - 1."""
    wide = text.astype(np.uint32)
    n = max(len(wide) - size + 1, 0)
    packed = wide[:n].copy()
    for k in range(1, size):
        packed |= wide[k : k + n] << np.uint32(8 * k)
    packed *= np.uint32(2654435761)
    packed >>= np.uint32(32 - BUCKET_BITS)
    return packed


@dataclass(frozen=True)
class Model:
    """languages: as learned, in order; log_p: (sizes, buckets, languages) log-probabilities less the languages' mean; prior: (languages,).

    mean: (sizes, buckets) that mean; least: (languages,) the least mean log-probability an n-gram that a typical text of the language has.
    """

    languages: tuple[str, ...]
    log_p: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    least: np.ndarray

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """(texts, 2): how many n-grams each text has, and the sum of what scores() leaves out of their log-probabilities."""
        out = np.zeros((len(texts), 2))
        for k, x in enumerate(map(fold, texts)):
            for table, size in zip(self.mean, SIZES, strict=True):
                found = grams(x, size)
                out[k] += len(found), table[found].sum(dtype=np.float64)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the log-probabilities of each text's n-grams, summed. They differ from whole ones by the same for all languages."""
        folded = [fold(x) for x in texts]
        lengths = np.array([len(x) for x in folded])
        ends = np.cumsum(lengths)
        joined = np.concatenate([*folded, np.full(max(SIZES), 32, np.uint8)])
        out = np.zeros((len(texts), len(self.languages)))
        for table, size in zip(self.log_p, SIZES, strict=True):
            found = table[grams(joined, size)[: ends[-1]]]
            for k in range(1, size):  # n-grams that reach into the next text
                found[np.maximum(ends - k, ends - lengths)] = 0
            out += np.add.reduceat(found, ends - lengths, axis=0)
        return out


def counts_of(texts: list[bytes]) -> np.ndarray:
    """(sizes x buckets,) n-gram counts over `texts`."""
    out = np.zeros((len(SIZES), 1 << BUCKET_BITS), np.int64)
    for x in texts:
        folded = fold(x)
        for k, size in enumerate(SIZES):
            out[k] += np.bincount(grams(folded, size), minlength=1 << BUCKET_BITS)
    return out.reshape(-1)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, smoothing: float = 0.5, typical: bool = False) -> Model:
    """Learn from the rows of `labelled` with a label and a text.

    More than `train_rows` of them are thinned by a hash of the text to about that many. Tasks count n-grams for each label, and the sums
    (labels x sizes x buckets at most) come to the driver. Each label has its row share, smoothed, as prior. With `typical` a second pass over these rows
    learns how unlikely a text of each label may be; without it every text is typical.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = rows.count()
    if n > train_rows:
        rows = rows.where(F.shiftrightunsigned(F.xxhash64("text"), 32) < F.lit(int(train_rows / n * 2**32)))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    by.setdefault(lang, []).append(text.encode())
            for lang, texts in by.items():
                sums[lang] = sums.get(lang, 0) + counts_of(texts)
                docs[lang] = docs.get(lang, 0) + len(texts)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(x[at], docs[lang]))], names=["lang", "gram", "n"])

    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(total["lang"].unique()))
    x = np.full((len(SIZES) << BUCKET_BITS, len(languages)), smoothing)
    prior = np.ones(len(languages))
    for k, lang in enumerate(languages):
        own = total[total["lang"] == lang]
        is_gram = own["gram"] >= 0
        x[own.loc[is_gram, "gram"], k] += own.loc[is_gram, "n"]
        prior[k] += own.loc[~is_gram, "n"].sum()
    by_size = x.reshape(len(SIZES), 1 << BUCKET_BITS, len(languages))
    log_p = np.log(by_size / by_size.sum(1, keepdims=True))
    mean = log_p.mean(2) if languages else np.zeros(log_p.shape[:2])
    model = Model(languages, (log_p - mean[:, :, None]).astype("f4"), np.log(prior / prior.sum()), mean.astype("f4"), np.full(len(languages), -np.inf))
    return replace(model, least=_least(rows, model)) if languages and typical else model


def _least(rows: DataFrame, model: Model) -> np.ndarray:
    """The least mean log-probability an n-gram among each language's labelled texts, less SLACK of it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @tidy
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        found: dict[str, float] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    raw = [text.encode()]
                    n, left_out = known.totals(raw)[0]
                    found[lang] = min(found.get(lang, np.inf), (known.scores(raw)[0, known.languages.index(lang)] + left_out) / n)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["lang", "least"])

    told = dict(rows.mapInArrow(least, "lang string, least double").groupBy("lang").agg(F.min("least")).collect())  # a row for each language
    return np.array([told[x] * (1 + SLACK) for x in model.languages])


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_pred_col: str = "lang_pred", score_col: str = "score", typical_col: str | None = None) -> DataFrame:
    """Add lang_pred and score, by the names given (columns of these names are replaced), to `docs`, by the text alone.

    lang_pred is a language of the model, or `und` (score 0) where the text is null or has no letter, or the model has no language. score is the
    posterior probability of the prediction; of languages that tie, the first in order wins. Whole texts are scored. The posterior only weighs the learned languages
    against each other; with `typical_col` a column tells whether the text is also as likely in the predicted one as its labelled texts are (false for `und`).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in (lang_pred_col, score_col, typical_col)]
    text_at = columns.index(text_col)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(lang_pred_col, T.StringType()), T.StructField(score_col, T.DoubleType()), *([T.StructField(typical_col, T.BooleanType())] if typical_col else [])])

    def pieces(text: bytes) -> Iterator[bytes]:
        """Overlapping so that every n-gram is in one piece: cut at a space, which both pieces get."""
        at = 0
        while len(text) - at > BATCH_BYTES:
            end = text.rfind(b" ", at + 1, at + BATCH_BYTES)
            end = end if end > at else at + BATCH_BYTES
            yield text[at:end]
            at = end
        yield text[at:]

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            wanted = [k for k, x in enumerate(texts) if x and has_letter(x)] if known.languages else []
            joint = np.tile(known.prior, (len(texts), 1))
            counted = np.zeros((len(texts), 2))
            part, owners, held = [], [], 0

            def flush() -> None:
                np.add.at(joint, owners, known.scores(part))
                if typical_col:
                    np.add.at(counted, owners, known.totals(part))
                part.clear()
                owners.clear()

            for k in wanted:
                for piece in pieces(texts[k].encode()):
                    part.append(piece)
                    owners.append(k)
                    held += len(piece)
                    if held >= BATCH_BYTES:
                        flush()
                        held = 0
            if part:
                flush()
            lang, p, typical = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            if wanted:
                x = joint[wanted]
                best = x.argmax(1)
                p[wanted] = 1 / np.exp(x - x.max(1, keepdims=True)).sum(1)
                if typical_col:
                    n, left_out = counted[wanted].T
                    typical[wanted] = (x[np.arange(len(x)), best] - known.prior[best] + left_out) / n >= known.least[best]
                for k, b in zip(wanted, best, strict=True):
                    lang[k] = known.languages[b]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(p), *([pa.array(typical)] if typical_col else [])], names=[f.name for f in schema])

    return docs.select(columns).mapInArrow(score, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is divisible by `folds` (null ids are kept from it)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))
