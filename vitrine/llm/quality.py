"""Quality classification: naive Bayes support vectors over hashed n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.workers import tidy
from vitrine.sources.shared import Scratch

#: Indicators are hashed into 2^18 buckets.
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: The fit takes a hash sample, by id, of about this many labelled ids, or all if there are fewer. It is broadcast to the documents as ids and labels.
TRAIN_ROWS = 16_384
#: Labelled rows of a block: what a task of a round fits at a time.
BLOCK_ROWS = 1024
#: Bytes of a text that are hashed at a time; a longer word is several.
PIECE = 1 << 18
#: Rounds of the fit, passes over its own rows that each block makes in a round, and the weight C of the hinge loss (shared out so that both labels have half).
ROUNDS, PASSES, COST = 6, 3, 1.0
#: How much of the fitted weights is used; the rest is their mean size for every indicator, which is naive Bayes alone.
BLEND = 0.5
#: One of so many sampled rows is kept from the fit, to turn margins into probabilities.
CALIBRATE = 5

_ODD = 0x9E3779B97F4A7C15
_SPACES = (32, 9, 10, 11, 12, 13)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte's class as a bit (space 0, capital 1, small letter 2, digit 4, not ASCII 8, other 16), and its value with A-Z lower-cased."""
    kind, low = np.full(256, 16, np.uint8), np.arange(256, dtype=np.uint64)
    kind[list(_SPACES)] = 0
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 4, 8
    low[65:91] += 32
    return kind, low + 1


_KIND, _LOW = _tables()


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    up, down = np.ones(PIECE, np.uint64), np.ones(PIECE, np.uint64)
    up[1:], down[1:] = _ODD, pow(_ODD, -1, 1 << 64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_ODD + 2 * salt)
    return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _pieces(text: bytes) -> Iterator[bytes]:
    """At most PIECE bytes each, cut behind a space where there is one."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else end
        yield text[at:end]
        at = end


def indicators(text: bytes) -> np.ndarray:
    """The distinct buckets, in order, of a text's n-grams: words (one and two in a row, A-Z lower-cased) and shapes of words (one to three).

    A word's shape: the kinds of its characters, of its first and last one, how many are neither letters nor digits (up to three), and whether it is the word before again.
    """
    up, down = _powers()
    words, shapes = np.zeros(2, np.uint64), np.zeros(2, np.uint64)  # what came before the piece; at first nothing
    found = []
    for piece in _pieces(text):
        x = np.frombuffer(piece, np.uint8)
        kind = _KIND[x]
        inside = kind > 0
        starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        if not len(starts):
            continue
        ends = np.flatnonzero(inside & np.concatenate([~inside[1:], [True]]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOW[x] * up[: len(x)], dtype=np.uint64)])
        w = (sums[ends + 1] - sums[starts]) * down[starts]
        w = np.concatenate([words, w])
        again = w[2:] == w[1:-1]
        odd = np.minimum(np.add.reduceat((kind == 16).astype(np.int64), starts), 3)
        last = np.where(kind[ends] == 16, x[ends], kind[ends])
        s = np.bitwise_or.reduceat(kind, starts).astype(np.uint64) | kind[starts].astype(np.uint64) << np.uint64(5) | last.astype(np.uint64) << np.uint64(10)
        s |= odd.astype(np.uint64) << np.uint64(18) | again.astype(np.uint64) << np.uint64(20) | np.uint64(1 << 21)
        s = np.concatenate([shapes, s * np.uint64(_ODD)])
        three, five, seven = np.uint64(3), np.uint64(5), np.uint64(7)
        grams = [_bucket(w[2:], 1), _bucket(w[2:] + w[1:-1] * three, 2), _bucket(s[2:], 3), _bucket(s[2:] + s[1:-1] * five, 4), _bucket(s[2:] + s[1:-1] * five + s[:-2] * seven, 5)]
        found.append(np.unique(np.concatenate(grams)))
        words, shapes = w[-2:], s[-2:]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    """A text's margin is the sum of `weight` over its indicators, by the root of the sum of `square`, and `bias`; its probability 1 / (1 + exp(-(slope * margin + shift)))."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        size = float(self.square[found].sum(dtype=np.float64)) if len(found) else 0.0
        return self.bias + (float(self.weight[found].sum(dtype=np.float64)) / size**0.5 if size > 0 else 0.0)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(indicators(text)) + self.shift, -500, 500))))


_BLOCK = "block int, labels binary, kept binary, sizes binary, found binary"


def _blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Labelled texts (id, good, text) as `blocks` rows: each text's label (1 or -1), whether it is kept for calibration, and its indicators."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        found = [indicators(x.encode()) for x in table.column("text").to_pylist()]
        labels = np.where(table.column("good").to_numpy(), 1, -1).astype(np.int8)
        kept = table.column("kept").to_numpy().astype(np.int8)
        sizes = np.array([len(x) for x in found], np.int32)
        joined = np.concatenate([np.zeros(0, np.int32), *found])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in (("labels", labels), ("kept", kept), ("sizes", sizes), ("found", joined))}})

    h = F.xxhash64("id", F.lit(1))
    dealt = rows.select("id", "good", "text", F.pmod(h, F.lit(blocks)).cast("int").alias("block"), (F.pmod(F.shiftright(h, 32), F.lit(CALIBRATE)) == 0).alias("kept"))
    return dealt.groupBy("block").applyInArrow(pack, _BLOCK)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    labels, kept = (np.frombuffer(row[n], np.int8) for n in ("labels", "kept"))
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
    return labels, kept > 0, np.split(np.frombuffer(row["found"], np.int32), ends[:-1])


def _ratios(blocks: DataFrame, smoothing: float) -> tuple[np.ndarray, int, int]:
    """Each bucket's log-count ratio between the two labels, over rows that aren't kept for calibration, and how many rows each label has."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for label, kept, found in zip(*_unpack(row), strict=True):
                    if not kept:
                        sums[int(label > 0), found] += 1
                        rows[int(label > 0)] += 1
        for k in (0, 1):
            at = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array([k] * (len(at) + 1), pa.int32()), pa.array(np.append(at, -1)), pa.array(np.append(sums[k, at], rows[k]))], names=["label", "bucket", "n"])

    total = blocks.mapInArrow(count, "label int, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    sums, rows = np.full((2, BUCKETS), smoothing), np.zeros(2, np.int64)
    for k in (0, 1):
        own = total[total["label"] == k]
        is_gram = own["bucket"] >= 0
        sums[k, own.loc[is_gram, "bucket"].to_numpy()] += own.loc[is_gram, "n"].to_numpy()
        rows[k] = own.loc[~is_gram, "n"].sum()
    p = sums / sums.sum(1, keepdims=True)
    return np.log(p[1] / p[0]), int(rows[0]), int(rows[1])


def _round(blocks: DataFrame, ratio: np.ndarray, w: np.ndarray, bias: float, alphas: dict[int, np.ndarray], n_blocks: int, costs: tuple[float, float]) -> list[dict]:
    """One round of dual coordinate descent on every block by itself, from the weights that all share.

    A block's steps count n_blocks-fold in its own margins, so that the blocks' changes of the weights may be added up.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((ratio, w, bias, alphas))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r, w, bias, alphas = shared.value
                labels, kept, found = _unpack(row)
                alpha = alphas.get(row["block"], np.zeros(len(labels))).copy()
                change, own = np.zeros(BUCKETS), 0.0
                values = []
                for x in found:
                    v = r[x]
                    size = np.sqrt(v @ v)
                    values.append(v / size if size > 0 else v)
                order = np.random.default_rng(row["block"])
                for _ in range(PASSES):
                    for i in order.permutation(np.flatnonzero(~kept)):
                        x, v, y = found[i], values[i], float(labels[i])
                        margin = (w[x] + n_blocks * change[x]) @ v + bias + n_blocks * own
                        size = n_blocks * (v @ v + 1)
                        new = min(max(alpha[i] + (1 - y * margin) / size, 0.0), costs[int(y > 0)])
                        if new != alpha[i]:
                            change[x] += (new - alpha[i]) * y * v
                            own += (new - alpha[i]) * y
                            alpha[i] = new
                at = np.flatnonzero(change).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int32()), pa.array([alpha.tobytes()], pa.binary()), pa.array([at.tobytes()], pa.binary()), pa.array([change[at].astype("f4").tobytes()], pa.binary()), pa.array([own])], names=["block", "alpha", "at", "change", "own"])

    rows = blocks.mapInArrow(work, "block int, alpha binary, at binary, change binary, own double").collect()
    shared.destroy()
    return sorted((r.asDict() for r in rows), key=lambda r: r["block"])


def _margins(blocks: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The margins and labels of the rows kept for calibration."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels, kept, found = _unpack(row)
                at = np.flatnonzero(kept)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(at), pa.int32()), pa.array(at), pa.array([shared.value.margin(found[i]) for i in at], pa.float64()), pa.array(labels[at])], names=["block", "at", "margin", "label"])

    told = blocks.mapInArrow(work, "block int, at long, margin double, label byte").toPandas().sort_values(["block", "at"])
    return told["margin"].to_numpy(), told["label"].to_numpy()


def _calibrate(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the labels, by Newton's method; each label's targets stay a pseudo-row away from 0 and 1."""
    up, down = (labels > 0).sum(), (labels <= 0).sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    a = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        a += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, smoothing: float = 1.0) -> Model:
    """Learn what tells texts labelled 1 from others, from the rows of `docs` whose id `labels` (id_col, label_col) labels.

    An id that labels name several times is good if they mostly say 1; null labels and ids aren't used. Of more than `train_rows` ids a hash sample of about
    that many is taken; it meets the documents as a broadcast of ids, so texts aren't shuffled but for the sample's. Of several rows with one id the
    greatest text counts (null: empty). Indicators are scaled by their log-count ratios and to unit length, then a hinge loss is fitted by dual
    coordinate descent in blocks, in rounds. With one label only, or none, every text has the smoothed share of 1 as its score.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        judged = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg((F.col(label_col) == 1).cast("int")) >= 0.5).alias("good"))
        judged = scratch.table(judged, "judged")
        n = judged.count()
        if n > train_rows:
            judged = judged.where(F.shiftrightunsigned(F.xxhash64("id"), 32) < F.lit(int(train_rows / n * 2**32)))
        met = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(judged), "id")
        rows = met.groupBy("id").agg(F.max("text").alias("text"), F.first("good").alias("good"))
        n_blocks = max(1, -(-min(n, train_rows) // BLOCK_ROWS))
        blocks = scratch.table(_blocks(rows, n_blocks), "blocks")
        ratio, bad, good = _ratios(blocks, smoothing)
        if not good or not bad:
            share = (good + 1) / (good + bad + 2)
            return Model(np.zeros(BUCKETS, "f4"), np.zeros(BUCKETS, "f4"), 0.0, 1.0, float(np.log(share / (1 - share))))
        w, bias, alphas = np.zeros(BUCKETS), 0.0, {}
        costs = (COST * (good + bad) / (2 * bad), COST * (good + bad) / (2 * good))
        for _ in range(ROUNDS):
            for row in _round(blocks, ratio, w, bias, alphas, n_blocks, costs):
                alphas[row["block"]] = np.frombuffer(row["alpha"])
                w[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["change"], "f4")
                bias += row["own"]
        blended = (1 - BLEND) * np.abs(w).mean() + BLEND * w
        model = Model((ratio * blended).astype("f4"), (ratio**2).astype("f4"), bias, 1.0, 0.0)
        slope, shift = _calibrate(*_margins(blocks, model))
    return Model(model.weight, model.square, bias, slope, shift)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add score (a column of that name is replaced): the probability of label 1 by the whole text alone; a null text is an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c.lower() != score_col.lower()]
    text_at = columns.index(text_col)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(score_col, T.DoubleType())])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score((x.as_py() or "").encode()) for x in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(columns).mapInArrow(work, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves `fold` when divided by `folds` (null ids are kept from it)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))
