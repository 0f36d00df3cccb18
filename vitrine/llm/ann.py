"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.workers import tidy
from vitrine.sources.shared import Scratch, materialize

#: The index is fitted on a hash sample of the distinct vectors: SHARE of them, but about TRAIN_ROWS at most. A sample of under LEAST times the rows that a query wants would say too little, so
#: tables of a few hundred vectors give more of theirs.
TRAIN_ROWS, SHARE, LEAST = 20_000, 0.25, 16
#: Queries of the sample that the probing is calibrated on, and the share of their true neighbours that the probed lists must hold.
CALIBRATION_QUERIES, COVERAGE = 1_000, 0.975
#: Dimensions of a product quantiser's part, and centroids of each.
PART_DIMS, PART_CENTROIDS = 4, 256
#: Lists for the root of the number of vectors, and the most there are.
LISTS, MOST_LISTS = 2.0, 2_048
#: Vectors that are searched at a time (of several lists, or a part of one), and queries that meet them at a time.
CELL_ROWS, QUERY_ROWS = 4_096, 1_024
#: Standard deviations of a quantised score that a row may lie under a query's bound and still be reranked.
SLACK = 2.5
#: Queries that are held against the sample at a time.
BOUND_QUERIES = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm; centroids that lose all rows stay. Fewer than `k` rows: the rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centroids)
        order = np.argsort(own, kind="stable")
        found, begin, n = np.unique(own[order], return_index=True, return_counts=True)
        centroids[found] = np.add.reduceat(x[order], begin, axis=0) / n[:, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The closest centroid of each row."""
    lengths = (centroids**2).sum(1)
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4_096):  # so many rows' distances are held at a time
        out[k : k + 4_096] = (lengths - 2 * (x[k : k + 4_096] @ centroids.T)).argmin(1)
    return out


@dataclass
class Index:
    """What tasks need to encode rows and to choose lists; its size depends on the sample alone.

    centroids: (lists, dims); codebooks: one (centroids, dims of the part) for each part; spread: for each list, the standard deviation of
    its rows' distance from the centroid in any one direction; margin: how many of those a list may miss a query's bound by and be probed all the same;
    sample: distinct vectors of the table, with an id, list and codes each.
    """

    centroids: np.ndarray
    codebooks: tuple[np.ndarray, ...]
    spread: np.ndarray
    sample: np.ndarray
    sample_lists: np.ndarray = field(default=None)
    sample_codes: np.ndarray = field(default=None)
    margin: float = 0.0

    @property
    def cuts(self) -> list[slice]:
        ends = np.cumsum([0] + [b.shape[1] for b in self.codebooks])
        return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, error): each row's closest centroid, the parts of what is left of it, and how far the row lies from what these tell."""
        own = nearest(x, self.centroids)
        left = x - self.centroids[own]
        codes = np.stack([nearest(left[:, c], b) for c, b in zip(self.cuts, self.codebooks, strict=True)], 1).astype(np.uint8)
        told = np.concatenate([b[codes[:, k]] for k, b in enumerate(self.codebooks)], 1)
        return own, codes, np.sqrt(((left - told) ** 2).sum(1))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(parts, queries, centroids): inner products of the queries' parts and the codebooks."""
        out = np.zeros((len(self.codebooks), len(q), PART_CENTROIDS))
        for k, (c, b) in enumerate(zip(self.cuts, self.codebooks, strict=True)):
            out[k, :, : len(b)] = q[:, c] @ b.T
        return out

    def probes(self, q: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lists to probe as a mask, bound, floor) of each query, for its `wanted` best rows.

        A list is probed if its centroid's score, and `margin` standard deviations, reach the score of the wanted-th best row of the sample; and further lists, best first, until they hold so
        many rows of the sample (all lists if it has fewer). bound is the score of the wanted-th best of the sample within these lists, so there are as many
        rows in them that reach it; floor is the least that their codes say of those rows.
        """
        score = q @ self.sample.T
        centre = q @ self.centroids.T
        length = np.sqrt((q**2).sum(1))
        if score.shape[1] < wanted:
            return np.ones(centre.shape, bool), np.full(len(q), -np.inf), np.full(len(q), -np.inf)
        limit = -np.partition(-score, wanted - 1, axis=1)[:, wanted - 1]
        reach = centre + self.margin * length[:, None] * self.spread
        probed = reach >= limit[:, None]
        sizes = np.bincount(self.sample_lists, minlength=len(self.centroids))
        for i in np.flatnonzero((probed * sizes).sum(1) < wanted):
            order = np.argsort(-reach[i], kind="stable")
            probed[i, order[: int(np.searchsorted(np.cumsum(sizes[order]), wanted)) + 1]] = True
        score[~probed[:, self.sample_lists]] = -np.inf
        best = np.argpartition(-score, wanted - 1, axis=1)[:, :wanted]
        rows = np.arange(len(q))[:, None]
        tables = self.tables(q)
        told = centre[rows, self.sample_lists[best]] + sum(tables[k][rows, self.sample_codes[best, k]] for k in range(len(tables)))
        return probed, score[rows, best].min(1), told.min(1)


def fit(sample: np.ndarray, rows: int, k: int) -> Index:
    """Fit on `sample`, for a table of `rows` distinct vectors.

    The lists grow as the root of the rows. The margin is the least that probes lists with COVERAGE of the `k` true neighbours, within the
    sample, of some of its rows.
    """
    lists = int(min(MOST_LISTS, max(1, LISTS * np.sqrt(rows))))
    centroids = kmeans(sample, lists)
    own = nearest(sample, centroids)
    left = sample - centroids[own]
    codebooks = tuple(kmeans(left[:, a : a + PART_DIMS], PART_CENTROIDS, rounds=6, seed=a) for a in range(0, sample.shape[1], PART_DIMS))
    around = np.sqrt((left**2).sum(1).mean() / sample.shape[1])
    n = np.bincount(own, minlength=len(centroids))
    # a list of few rows takes after the others
    spread = np.sqrt((np.bincount(own, (left**2).sum(1), minlength=len(centroids)) / sample.shape[1] + 4 * around**2) / (n + 4))
    index = Index(centroids, codebooks, np.maximum(spread, 1e-12), sample)
    index.sample_lists, index.sample_codes, _ = index.encode(sample)
    queries = np.random.default_rng(1).permutation(len(sample))[:CALIBRATION_QUERIES]
    needed = []
    for some in np.array_split(queries, -(-len(queries) // BOUND_QUERIES)):
        q = sample[some]
        score = q @ sample.T
        score[np.arange(len(q)), some] = -np.inf
        best = np.argpartition(-score, min(k, len(sample) - 1), axis=1)[:, : min(k, len(sample) - 1)]
        at = np.arange(len(q))[:, None]
        limit = score[at, best].min(1, keepdims=True) if best.shape[1] else np.zeros((len(q), 1))
        lists_ = own[best]
        needed.append(((limit - (q @ centroids.T)[at, lists_]) / (np.sqrt((q**2).sum(1, keepdims=True)) * index.spread[lists_])).ravel())
    needed = np.concatenate(needed)
    index.margin = float(np.quantile(needed, COVERAGE)) if len(needed) else 0.0
    return index


def _vectors(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, dims)


def usable(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec) with the vectors' bytes as doubles, and their dimension (0 if there are none).

    Rows that are null in id or vector, hold null or non-finite components, or are zero are left out; rows that are alike count once. Vectors of
    different dimensions are an error, as they have no inner product.
    """
    value = F.col(vector_col).cast("array<double>")
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists("v", lambda c: c != 0)
    whole = table.select(F.col(id_col).cast("long").alias("vec_id"), value.alias("v")).where("v IS NOT NULL").where(sound).select("vec_id", "v")
    sizes = whole.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if sizes["least"] != sizes["most"]:
        raise ValueError(f"vectors of {sizes['least']} and of {sizes['most']} dimensions have no inner product")

    @tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            width = 8 * (sizes["most"] or 1)
            raw = x.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[k : k + width] for k in range(0, len(raw), width)], pa.binary())], names=["vec_id", "vec"])

    return whole.mapInArrow(encode, "vec_id long, vec binary").distinct(), sizes["most"] or 0


def cells(sizes: np.ndarray, cell_rows: int = CELL_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each list, blocks of each list): lists in order, together until they have `cell_rows` rows; a larger list is a cell of its own, in several blocks."""
    cell, blocks = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // cell_rows))
    at, held = 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > cell_rows:
            at, held = at + 1, 0
        cell[k] = at
        held += n
    return cell, blocks


def dealt(probes: DataFrame, entries: DataFrame, cell_of: np.ndarray, blocks_of: np.ndarray, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """`probes` (cell, query, ..) once for each block of the cell's `entries` (list, node, ..), and `entries` once for each part of the cell's queries.

    Both get (cell, block, part): by hashes, about so many rows as cells() says and about `query_rows` queries, so that each query meets each
    entry of the cells that it probes just once. Cells without queries are left out.
    """
    spark = probes.sparkSession
    # a row for each list or cell, MOST_LISTS at most
    of_list = spark.createDataFrame([(k, int(c), int(b)) for k, (c, b) in enumerate(zip(cell_of, blocks_of, strict=True))], "list long, cell long, blocks int")
    of_cell = of_list.groupBy("cell").agg(F.max("blocks").alias("blocks"))
    parts = F.broadcast(materialize(probes.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("parts")).join(of_cell, "cell"), "parts"))
    turns, pieces = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "blocks"))
    placed = entries.join(F.broadcast(of_list.select("list", "cell")), "list").join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("part", turns)
    asking = probes.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int")).withColumn("block", pieces)
    return asking.drop("blocks", "parts"), placed.drop("blocks", "parts")


def best_of(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` best rows of each query, ids once each, ties by id."""
    order = np.lexsort((vec_id, -score, query))
    # of an id found twice the better one stays
    first = np.lexsort((-score, vec_id, query))
    again = np.zeros(len(query), bool)
    again[first[1:]] = (query[first[1:]] == query[first[:-1]]) & (vec_id[first[1:]] == vec_id[first[:-1]])
    order = order[~again[order]]
    q = query[order]
    begin = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
    return order[nth < k]


def search(table: DataFrame, queries_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` rows found with the largest inner product for each row whose id is divisible by `queries_every`.

    Candidates are all other rows (of other ids) of the table; ties go to the smaller id; score is the inner product in doubles. Unusable vectors (see
    usable()) take no part; of an id with several vectors, the one with the smallest bytes asks, and the nearest one is found. With at most `k` candidates all are found; an empty table gives none.

    Every row is in the index. Equal vectors are one entry with their k + 1 smallest ids, as no others can be found, and equal queries are searched once, so copies cost nothing. A sample bounds
    from below what a query can find, and lists that hardly reach its bound aren't probed. Cells of about CELL_ROWS entries, of lists that lie next to each other or a part of one, meet
    about QUERY_ROWS of their queries at a time, each sent once a cell. Asymmetric distance tables tell the entries that may reach the bound, SLACK standard deviations allowed for, and those are ranked by their own values.
    """
    spark = table.sparkSession
    vectors, dims = usable(table, id_col, vector_col)
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], out_schema)
    wanted = k + 1  # the query's own row is found too
    with Scratch(spark) as work:
        vectors = work.table(vectors, "vectors")
        by_id = Window.partitionBy("vec").orderBy("vec_id")
        least = vectors.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= wanted)
        entries = work.table(least.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.monotonically_increasing_id().alias("node"), "vec", "ids"), "entries")
        rows = entries.count()
        share = min(1.0, max(min(SHARE, train_rows / max(rows, 1)), LEAST * wanted / max(rows, 1)))
        thinned = entries.where(F.shiftrightunsigned(F.xxhash64("vec"), 32) < F.lit(int(share * 2**32)))
        sample = thinned.select("vec", F.col("ids")[0].alias("vec_id")).toPandas().sort_values(["vec_id", "vec"]).drop_duplicates("vec_id")
        sample = _vectors(sample["vec"], dims)[np.random.default_rng(0).permutation(len(sample))]
        index = spark.sparkContext.broadcast(fit(sample, rows, k))

        @tidy
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    own, codes, error = index.value.encode(_vectors(batch.column(1), dims))
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["list", "node", "vec", "ids", "codes", "error"])

        entries = work.table(entries.mapInArrow(assign, "list long, node long, vec binary, ids array<long>, codes binary, error double"), "index")
        sizes = np.zeros(len(index.value.centroids), np.int64)
        for r in entries.groupBy("list").count().collect():
            sizes[r["list"]] = r["count"]
        cell_of, blocks_of = cells(sizes)

        @tidy
        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), BOUND_QUERIES):
                    own = batch.slice(start, BOUND_QUERIES)
                    probed, bound, floor = index.value.probes(_vectors(own.column(1), dims), wanted)
                    query, lists = np.nonzero(probed & (sizes > 0))
                    turn = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (cell_of[lists[1:]] != cell_of[lists[:-1]]))[: len(query)])
                    at = pa.array(query[turn])
                    told = pa.ListArray.from_arrays(pa.array(np.append(turn, len(query)), pa.int32()), pa.array(lists.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(cell_of[lists[turn]]), own.column(0).take(at), own.column(1).take(at), pa.array(bound[query[turn]]), pa.array(floor[query[turn]]), told], names=["cell", "query", "query_vec", "bound", "floor", "lists"])

        asked = vectors.where(F.col("vec_id") % queries_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
        asked = work.table(asked.join(entries.select("vec", "node"), "vec").select("query_id", F.col("node").alias("query"), "vec"), "asked")
        probes = asked.groupBy("query").agg(F.first("vec").alias("vec")).mapInArrow(probe, "cell long, query long, query_vec binary, bound double, floor double, lists array<int>")
        probes = work.table(probes, "probes")
        asking, placed = dealt(probes, entries, cell_of, blocks_of)

        def meet(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
            if not len(asking) or not len(held):
                return none
            own = index.value
            held = held.sort_values("list", kind="stable")
            x, lists, error = _vectors(held["vec"], dims), held["list"].to_numpy(), held["error"].to_numpy()
            codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(x), -1)
            q, bound, floor = _vectors(asking["query_vec"], dims), asking["bound"].to_numpy(), asking["floor"].to_numpy()
            length = np.sqrt((q**2).sum(1))
            tables = own.tables(q)
            n = asking["lists"].map(len).to_numpy()
            who, which = np.repeat(np.arange(len(q)), n), np.concatenate(asking["lists"].to_numpy())
            order = np.argsort(which, kind="stable")
            who, which = who[order], which[order]
            # a score is off by about the query's length times the row's error, over the root of the dimensions
            slack = SLACK / np.sqrt(dims) * error
            found = []
            for one in np.unique(lists):
                a, b = np.searchsorted(lists, [one, one + 1])
                i = who[slice(*np.searchsorted(which, [one, one + 1]))]
                if not len(i):
                    continue
                near = np.repeat((q[i] @ own.centroids[one])[:, None], b - a, axis=1)
                for part in range(len(tables)):
                    near += tables[part][i][:, codes[a:b, part]]
                tiny = 1e-9 * (np.abs(floor[i]) + length[i])
                hit = (near + length[i][:, None] * slack[a:b] >= bound[i][:, None]) | (near >= (floor[i] - tiny)[:, None])
                at, row = np.nonzero(hit)
                for k_ in range(0, len(at), 65_536):
                    some, rows_ = i[at[k_ : k_ + 65_536]], a + row[k_ : k_ + 65_536]
                    score = (x[rows_] * q[some]).sum(1)
                    good = score >= bound[some] - 1e-9 * (np.abs(bound[some]) + length[some])
                    found.append((some[good], rows_[good], score[good]))
            if not found:
                return none
            some, rows_, score = (np.concatenate(c) for c in zip(*found, strict=True))
            ids = held["ids"].to_numpy()
            copies = np.array([len(v) for v in ids])
            every = np.concatenate(ids)
            begin = np.cumsum(copies) - copies
            if len(np.unique(every)) == len(every):  # no id has two vectors here, so the best entries have the best ids
                kept = best_of(some, every[begin[rows_]], score, wanted)
                some, rows_, score = some[kept], rows_[kept], score[kept]
            n = copies[rows_]
            at = np.repeat(begin[rows_] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            some, score, found_ids = np.repeat(some, n), np.repeat(score, n), every[at]
            kept = best_of(some, found_ids, score, wanted)
            return pd.DataFrame({"query": asking["query"].to_numpy()[some[kept]], "vec_id": found_ids[kept], "score": score[kept]})

        by = ("cell", "block", "part")
        asking = asking.select(*by, "query", "query_vec", "bound", "floor", "lists")
        placed = placed.select(*by, "list", "vec", "ids", "codes", "error")
        scored = asking.groupBy(*by).cogroup(placed.groupBy(*by)).applyInPandas(meet, "query long, vec_id long, score double")
        scored = scored.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        top = scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= wanted).drop("nth")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        told = asked.select("query_id", "query").join(top, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        return materialize(told.select("query_id", "rank", "vec_id", "score"), "neighbours")
