"""SimHash near-duplicates: word-shingle fingerprints, linked by a generalised pigeonhole search in Hamming space."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.components import components
from vitrine.llm.workers import tidy
from vitrine.sources.shared import Scratch, few, materialize, sweep

BITS = 64
SEED = 42
#: Hashes that a task turns into bits at a time.
HASHES = 1 << 18
#: Fingerprints of one key that a task compares with each other; a key with more is split by further bits.
BUCKET_ROWS = 2048
#: What comparing a candidate costs, where sending a key costs 1.
VERIFY_COST = 0.01
#: Numbers of partitions that the planner weighs.
PARTITIONS = (2, 3, 4, 5, 6, 7)
#: Beyond this radius a key with too many fingerprints is split into pairs of blocks, not by further bits: near copies agree in most of those.
SPLIT_RADIUS = 4
#: Texts that tell which runs are common, and how many of those are remembered.
SAMPLE_ROWS, COMMON_RUNS = 4_000, 100_000
#: 64-bit words of the sketch that spares most candidates a comparison, the standard deviations that it allows for, and the runs under which a set isn't judged by it.
SKETCH_WORDS, DEVIATIONS, LEAST_SKETCHED = 2, 5.0, 64
#: 64-bit words of the parities that tell how many runs two sets differ in at least.
PARITY_WORDS = 8
#: Bits of 64 within which the pigeonhole search finds the closest copies.
COPY_RADIUS = 3

_BYTES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of `words` words of the text with A-Z lower-cased; of all its words if they are fewer."""
    w = (text or "").encode().lower().split()  # splits at bytes 0x20 and 0x09 to 0x0D
    if not w:
        return []
    runs = map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return [digest(x, SEED) for x in runs]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `hashes`: the bits that are set in over half of the run (none: 0).

    Eight bits at a time are spread over the bytes of a word, so sums of up to 255 words count 64 bits without carrying.
    """
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    chunks = -(-n // 255)
    begin = np.repeat(np.cumsum(n) - n, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    of_text = np.cumsum(chunks) - chunks
    found = np.zeros(len(some), np.uint64)
    for bit in range(8):
        part = np.add.reduceat((hashes >> np.uint64(bit)) & _BYTES, begin)
        counts = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), of_text, axis=0)
        for byte in range(8):
            found |= (2 * counts[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[some] = found
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): each row's 64-bit SimHash over shingles of `words` words, as a signed long. Texts without a word, and nulls, have 0."""

    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, hashes, sizes, held = [], [], [], 0

            def flush() -> None:
                joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                prints.append(majority_bits(joined, np.array(sizes, np.int64)))
                hashes.clear()
                sizes.clear()

            for text in (x.as_py() for x in batch.column(1)):
                h = np.array(shingle_hashes(text, words), np.uint64)
                hashes.append(h)
                sizes.append(len(h))
                held += len(h)
                if held >= HASHES:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "fp"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType(), False)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, schema)


def sketch_distance(similarity: float, bits: int = 64 * SKETCH_WORDS, deviations: float = 1.5) -> int:
    """The differing bits under which texts of this Jaccard similarity or more stay, but for what lies over `deviations` standard deviations off.

    Sets of equal size with similarity J have the cosine 2J / (1 + J); a bit differs with the probability of their angle over pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


@dataclass(frozen=True)
class Plan:
    """masks: the bits of each partition; thresholds: most differing bits to probe in it, -1 for none."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def group_bits(correlation: np.ndarray, partitions: int) -> tuple[int, ...]:
    """Masks of about equal size; each grows by the bit that correlates most with those it has."""
    left = set(range(BITS))
    strength = np.abs(correlation) - np.eye(BITS)
    masks = []
    for k in range(partitions):
        own = [max(left, key=lambda b: (strength[b, sorted(left)].sum(), -b))]
        left -= {*own}
        while len(own) < -(-(BITS - sum(m.bit_count() for m in masks)) // (partitions - k)):
            best = max(left, key=lambda b: (strength[b, own].sum(), -b))
            own.append(best)
            left.discard(best)
        masks.append(sum(1 << b for b in own))
    return tuple(masks)


def allocate(radius: int, costs: list[dict[int, float]]) -> tuple[float, tuple[int, ...]]:
    """The cheapest thresholds, one a partition, that sum to radius - partitions + 1: then no pair within `radius` is missed.

    If every partition differed in more bits than its threshold, they would differ in more than `radius` together. By dynamic programming over the sum so far.
    """
    goal = radius - len(costs) + 1
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for cost in costs:
        then: dict[int, tuple[float, tuple[int, ...]]] = {}
        for total, (spent, taken) in best.items():
            for t, c in cost.items():
                new = (spent + c, (*taken, t))
                if total + t not in then or new < then[total + t]:
                    then[total + t] = new
        best = then
    return best[goal]


def ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def plan_search(prints: DataFrame, radius: int) -> Plan:
    """Partition the bits and allocate thresholds from statistics of all of `prints` (column fp, distinct).

    One pass counts pairs of set bits, for the correlations; another compares each fingerprint with a few that lie near it in its batch, in hash
    order, and counts how far apart they are in each partition of every grouping. A threshold's cost is its probes and the
    candidates that these shares promise. What reaches the driver has a fixed size.
    """

    def bits(batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
        return np.unpackbits(x, axis=1, bitorder="little").astype(np.float32)

    @tidy
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = bits(batch)
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["cell", "n"])

    cells = prints.select("fp").mapInArrow(both, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    if not cells:
        return Plan(group_bits(np.eye(BITS), radius + 1), (0,) * (radius + 1))
    flat = np.zeros(BITS * BITS + 1)
    for r in cells:
        flat[r["cell"]] = r["n"]
    rows = flat[-1]
    p11 = flat[:-1].reshape(BITS, BITS) / max(rows, 1)
    p = np.diag(p11)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    groupings = {m: group_bits((p11 - np.outer(p, p)) / np.outer(spread, spread), m) for m in PARTITIONS if m <= radius + 2}

    @tidy
    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {m: np.zeros((m, radius + 2), np.int64) for m in groupings}
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for shift in (1, 2, 3, 5):
                if len(fp) > shift:
                    x = fp[shift:] ^ fp[:-shift]
                    for m, masks in groupings.items():
                        for k, mask in enumerate(masks):
                            found[m][k] += np.bincount(np.minimum(np.bitwise_count(x & np.uint64(mask)), radius + 1), minlength=radius + 2)
        rows = [(m, k, d, int(n)) for m, x in found.items() for k, own in enumerate(x) for d, n in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["m", "part", "d", "n"])

    share = {m: np.zeros((m, radius + 2)) for m in groupings}
    for r in prints.select("fp").mapInArrow(apart, "m long, part long, d long, n long").groupBy("m", "part", "d").agg(F.sum("n").alias("n")).collect():
        share[r["m"]][r["part"], r["d"]] = r["n"]
    best = None
    for m, masks in groupings.items():
        costs = []
        for k, mask in enumerate(masks):
            width, pairs = mask.bit_count(), share[m][k].sum()
            near = {t: (share[m][k][: t + 1].sum() + ball(width, t) / 2**width) / (pairs + 1) for t in range(radius + 1)}
            costs.append({-1: 0.0} | {t: ball(width, t) + VERIFY_COST * rows * near[t] for t in near})
        cost, thresholds = allocate(radius, costs)
        if best is None or cost < best[0]:
            best = (cost, Plan(masks, thresholds))
    return best[1]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many links as needed to connect what links a-b connect: each node with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[linked]], nodes[linked]


def hamming_links(prints: DataFrame, radius: int, plan: Plan | None = None, bucket_rows: int = BUCKET_ROWS, sketch_radius: int | None = None, work: Scratch | None = None) -> DataFrame:
    """Links (a, b) that connect just what pairs of `prints` (columns fp, node; distinct) within `radius` bits connect.

    Each fingerprint is sent to the key of its bits in every partition with a threshold of 0 or more, and as a guest to the keys within
    the threshold. A key with over `bucket_rows` is split: its fingerprints go to the keys of radius + 1 groups of the bits
    not used yet, one of which agrees in any pair that is wanted. The bits run out, so every key gets small enough. Beyond a
    radius of SPLIT_RADIUS the key is cut into blocks instead, and each pair of blocks meets in a key of its own. Tasks
    compare the rows of a key and return a spanning forest of what is near, so links never outnumber keys.

    With `sketch_radius`, `prints` has a column sketch too (binary), and pairs must also differ in at most so many of its bits. Tables between go to `work`,
    and are needed until the links are written.
    """
    plan = plan or plan_search(prints, radius)
    table = work.table if work else materialize
    node_type = prints.schema["node"].dataType
    extra = [] if sketch_radius is None else ["sketch"]
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("used", T.LongType()), T.StructField("home", T.BooleanType()), T.StructField("fp", T.LongType()), T.StructField("node", node_type), *(prints.schema[c] for c in extra)])

    def batch_of(key, used, home, fp, *rest) -> pa.RecordBatch:
        signed = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (key, used)]
        return pa.RecordBatch.from_arrays([*signed, pa.array(home), pa.array(np.ascontiguousarray(fp).view(np.int64)), *rest], names=[f.name for f in schema])

    def key_of(bits: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Keys of different masks may meet by chance; what they hold is compared like any other."""
        x = (bits ^ (used * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(32))

    @tidy
    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for mask, threshold in zip(plan.masks, plan.thresholds, strict=True):
                own = [1 << b for b in range(BITS) if mask >> b & 1]
                used = np.full(len(fp), mask, np.uint64)
                for k in range(threshold + 1):
                    for flip in combinations(own, k):
                        yield batch_of(key_of((fp & used) ^ np.uint64(sum(flip)), used), used, np.full(len(fp), k == 0), fp, *batch.columns[1:])

    @tidy
    def further_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, used, fp = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1, 3))
            home = batch.column(2).to_numpy(zero_copy_only=False)
            for mask in np.unique(used):
                at = np.flatnonzero(used == mask)
                free = [b for b in range(BITS) if not int(mask) >> b & 1]
                for k in range(radius + 1):
                    more = np.uint64(sum(1 << b for b in free[k :: radius + 1]))
                    yield batch_of(key_of(fp[at] & more, key[at] ^ more), used[at] | more, home[at], fp[at], *(c.take(pa.array(at)) for c in batch.columns[4:]))

    @tidy
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key; the last key's rows of a batch wait for the next."""

        def links(x: pa.Table) -> pa.RecordBatch:
            key, home, fp = (x.column(c).to_numpy() for c in ("key", "home", "fp"))
            node, fp = x.column("node").to_numpy(), fp.view(np.uint64)
            sketch = np.frombuffer(b"".join(x.column("sketch").to_pylist()), np.uint64).reshape(len(fp), -1) if extra else None
            a, b = [], []
            at = np.arange(len(key) - 1)
            step = 1
            while len(at := at[at + step < len(key)]) and len(at := at[key[at] == key[at + step]]):
                hit = at[(np.bitwise_count(fp[at] ^ fp[at + step]) <= radius) & (home[at] | home[at + step])]
                if extra:
                    hit = hit[np.bitwise_count(sketch[hit] ^ sketch[hit + step]).sum(1, dtype=np.int64) <= sketch_radius]
                a.append(node[hit])
                b.append(node[hit + step])
                step += 1
            a, b = forest(np.concatenate(a), np.concatenate(b)) if a else (node[:0], node[:0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.Table] = []
        for batch in batches:
            new = pa.Table.from_batches([batch])
            keys = new.column("key").to_numpy()
            if not len(keys):
                continue
            cut = int(np.flatnonzero(keys == keys[-1])[0]) if keys[0] != keys[-1] else 0
            if cut:
                yield links(pa.concat_tables([*held, new.slice(0, cut)]))
                held = [new.slice(cut)]
            elif held and held[-1].column("key")[-1].as_py() != keys[0]:
                yield links(pa.concat_tables(held))
                held = [new]
            else:
                held.append(new)
        if held:
            yield links(pa.concat_tables(held))

    def block_pairs(keys: DataFrame) -> DataFrame:
        """Every row `blocks` times: once for each block that its own meets."""
        own = F.pmod(F.xxhash64("fp", "node"), F.col("blocks"))
        met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        told = keys.withColumn("own", own).withColumn("met", met)
        return told.withColumn("key", F.xxhash64("key", F.least("own", "met"), F.greatest("own", "met"))).select(schema.names)

    keys = prints.select("fp", "node", *extra).where("node IS NOT NULL").mapInArrow(first_keys, schema)
    small = []
    while True:
        if radius > SPLIT_RADIUS:
            sizes = keys.groupBy("key").count().where(F.col("count") > 2 * bucket_rows)
            hot = table(sizes.select("key", F.ceil(F.col("count") / bucket_rows).alias("blocks")), "hot")
            if hot.isEmpty():
                small.append(keys)
            else:
                told = keys.join(hot, "key", "left")
                small += [told.where("blocks IS NULL").select(schema.names), block_pairs(told.where("blocks IS NOT NULL"))]
            break
        hot = table(keys.where(F.bit_count("used") < BITS - int(math.log2(bucket_rows))).groupBy("key").count().where(F.col("count") > bucket_rows).select("key", F.lit(True).alias("hot")), "hot")
        if hot.isEmpty():
            small.append(keys)
            break
        told = keys.join(hot, "key", "left")
        small.append(told.where("hot IS NULL").drop("hot").select(keys.columns))
        keys = table(told.where("hot").drop("hot").select(keys.columns).mapInArrow(further_keys, schema), "keys")
    union = small[0]
    for more in small[1:]:
        union = union.unionByName(more)
    met = union.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(near, T.StructType([T.StructField("a", node_type), T.StructField("b", node_type)]))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`.

    Rows whose fingerprints differ in at most `radius` bits are linked, whatever their texts; component_id is the smallest id
    reachable over links. Texts without a word, and nulls, have fingerprint 0 and are linked like others; repeated rows and
    ids are rows of their own; a row without an id gets the component of its fingerprint's other rows, or null if there is none. Equal
    fingerprints are one node, so a group of copies costs one row in the search.
    """
    prints = materialize(fingerprints(docs, words, id_col, text_col), "prints")
    with Scratch(docs.sparkSession) as work:
        nodes = work.table(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
        links = work.table(hamming_links(nodes, radius, work=work), "links")
        roots = components(links, work)
        known = materialize(nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "components")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def least_shared(n: int | np.ndarray, similarity: float) -> np.ndarray:
    """The least runs that a set of `n` shares with any set of this Jaccard similarity or more."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def alike(n_a: np.ndarray, at_a: np.ndarray, n_b: np.ndarray, at_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity if the first run that they share lies at these places in their orders."""
    wanted = np.ceil(similarity / (1 + similarity) * (n_a + n_b) - 1e-9)
    return np.minimum(n_a - at_a, n_b - at_b) >= wanted


def common_runs(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count), by hash, of the COMMON_RUNS most frequent runs that come at least thrice in about SAMPLE_ROWS texts, chosen by their hash."""
    share = SAMPLE_ROWS / max(docs.count(), 1)
    texts = docs.select(F.col(text_col).alias("text")).where(F.shiftrightunsigned(F.xxhash64("text"), 32) < F.lit(int(min(share, 1) * 2**32))).distinct()

    @tidy
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.array(shingle_hashes(text.as_py(), words), np.uint64)).view(np.int64))], names=["run"])

    counts = texts.mapInArrow(of, "run long").groupBy("run").count().where("count >= 3").orderBy(F.desc("count"), "run").limit(COMMON_RUNS).toPandas()
    runs, n = counts["run"].to_numpy(np.int64).view(np.uint64), counts["count"].to_numpy(np.int64)
    order = np.argsort(runs)
    return runs[order], n[order]


def sketches(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """SKETCH_WORDS words for each run of `hashes`: its fingerprint, and those of the same hashes mixed anew."""
    out = []
    for _ in range(SKETCH_WORDS):
        out.append(majority_bits(hashes, sizes).view(np.int64))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes = hashes ^ (hashes >> np.uint64(32))
    return out


def parities(hashes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """PARITY_WORDS words for each run of `hashes`: every hash has one bit, and a bit is set if an odd number of hashes has it.

    A run that only one of two sets has changes one bit, so two sets differ in at least as many runs as their parities in bits.
    """
    starts = np.cumsum(sizes) - sizes
    bits = np.append(np.uint64(1) << (hashes & np.uint64(63)), np.uint64(0))
    word = np.append((hashes >> np.uint64(6)) % np.uint64(PARITY_WORDS), np.uint64(PARITY_WORDS))
    out = []
    for k in range(PARITY_WORDS):
        found = np.bitwise_xor.reduceat(np.where(word == k, bits, np.uint64(0)), starts) if len(starts) else np.zeros(0, np.uint64)
        out.append(np.where(sizes > 0, found, np.uint64(0)).view(np.int64))
    return out


def most_apart(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """The most runs that sets of these sizes may differ in, to have the similarity."""
    return n_a + n_b - 2 * np.ceil(similarity / (1 + similarity) * (n_a + n_b) - 1e-9)


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole keys (column run), from batches sorted by key: the last key's rows of a batch wait for the next."""
    held: list[pa.Table] = []
    for batch in batches:
        new = pa.Table.from_batches([batch])
        runs = new.column("run").to_numpy()
        if not len(runs):
            continue
        if held and held[-1].column("run")[-1].as_py() != runs[0]:
            yield pa.concat_tables(held)
            held = []
        cut = int(np.flatnonzero(runs == runs[-1])[0])
        if cut:
            yield pa.concat_tables([*held, new.slice(0, cut)])
            held = [new.slice(cut)]
        else:
            held.append(new)
    if held:
        yield pa.concat_tables(held)


def near_copies(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text_key, component_id, kept) for every row of `docs`: texts whose sets of runs of `words` words have this Jaccard similarity or more are linked.

    The closest copies are candidates by the pigeonhole search over the sets' SimHash fingerprints. At the limit, fingerprints differ in more bits than any such search
    can tell from chance, so a join finds all others: runs have one order (rare ones of a sample before common ones, then by hash), and sets of n runs that are similar enough share one
    of their first n - least_shared(n) + 1. Sizes and places leave few of these candidates; parities, which never tell too much of a difference, and longer SimHash sketches (of sets that aren't small,
    DEVIATIONS standard deviations allowed for) leave hardly any others than near copies, before a pair is a row. These are decided on their whole sets: first each set with two of those that
    follow it by size under its keys, then, as groups of copies are connected by now, only pairs of different components. A run with over `bucket_rows` sets is dealt into pairs of blocks, so no task holds more than a few blocks. Runs and sets are told by 64-bit hashes.

    component_id is the smallest id reachable, text_key the text's xxhash64, and kept tells the rows of the one id and text that stay for the component. Nulls and texts without
    a word are linked with each other; a row without an id gets the component of the others with its runs, or null. Rows alike in id and text have the same result, so all of them
    may be kept; rows of one id with texts that aren't near copies are in components of their own.
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(common_runs(docs, words, text_col))

    def ordered(text: str | None) -> np.ndarray:
        return np.unique(np.array(shingle_hashes(text, words), np.uint64))

    def node_of(runs: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(runs.tobytes(), SEED) - 2**63

    @tidy
    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = common.value
        for batch in batches:
            node, sizes, first, told_, held, since = [], [], [], [], [], 0

            def flush() -> None:
                nonlocal since
                joined, lengths = np.concatenate(held) if held else np.zeros(0, np.uint64), np.array([len(x) for x in held], np.int64)
                told_.append([*sketches(joined, lengths), *parities(joined, lengths)])
                held.clear()
                since = 0

            for text in batch.column(1):
                runs = ordered(text.as_py())
                kept = len(runs) - int(least_shared(len(runs), similarity)) + 1 if len(runs) else 0
                if len(known) and len(runs):
                    at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                    frequent = np.where(known[at] == runs, count[at], 0)
                    first.append(runs[np.argsort(frequent, kind="stable")[:kept]].tobytes())
                else:
                    first.append(runs[:kept].tobytes())
                node.append(node_of(runs))
                sizes.append(len(runs))
                held.append(runs)
                since += len(runs)
                if since >= HASHES:
                    flush()
            flush()
            told = [pa.array(np.concatenate(x)) for x in zip(*told_, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(sizes, pa.int32()), *told, pa.array(first, pa.binary())], names=schema.names)

    @tidy
    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first runs of every set that this task didn't see before, so that copies cost one set a task."""
        seen: set[int] = set()
        for batch in batches:
            node, n = (batch.column(c).to_numpy() for c in (0, 1))
            new = np.zeros(len(node), bool)
            for k, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    new[k] = True
            node, n = node[new], n[new]
            first = batch.column(2).filter(pa.array(new)).to_pylist()
            sizes = np.array([len(x) // 8 for x in first], np.int64)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            node, n = np.repeat(node, sizes), np.repeat(n, sizes)
            runs = np.frombuffer(b"".join(first), np.int64)
            for k in range(0, len(runs), HASHES):
                own = slice(k, k + HASHES)
                yield pa.RecordBatch.from_arrays([pa.array(runs[own]), pa.array(node[own]), pa.array(n[own].astype(np.int32)), pa.array(at[own].astype(np.int32))], names=["run", "node", "n", "at"])

    @tidy
    def met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of keys with several, once each, with the next one's node if the two may be near copies. Of a key only the last row waits for the next batch."""
        none = np.zeros(0, np.int64)
        held, follows = (none,) * 4, False

        def out(columns: tuple[np.ndarray, ...], follows: bool, ended: bool) -> tuple[pa.RecordBatch, tuple[np.ndarray, ...], bool]:
            run, node, n, at = columns
            fresh_ = np.ones(len(run), bool)
            fresh_[1:] = (run[1:] != run[:-1]) | (node[1:] != node[:-1])
            run, node, n, at = (c[fresh_] for c in columns)
            done = len(run) if ended else max(len(run) - 1, 0)
            same = run[1:] == run[:-1]
            before = np.append(follows, same)[: len(run)]
            after = np.append(same, False)[: len(run)]
            next_ = np.append(same & alike(n[:-1], at[:-1], n[1:], at[1:], similarity), False)[: len(run)]
            then = np.append(node[1:], 0)[: len(run)]
            kept = (before | after)[:done]
            told = [pa.array(c[:done][kept]) for c in (run, node)] + [pa.array(c[:done][kept].astype(np.int32)) for c in (n, at)]
            told.append(pa.array(then[:done][kept], mask=~next_[:done][kept]))
            return pa.RecordBatch.from_arrays(told, names=["run", "node", "n", "at", "next"]), (run[done:], node[done:], n[done:], at[done:]), bool(before[-1]) if len(run) else follows

        for batch in batches:
            columns = tuple(np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("run", "node", "n", "at"), strict=True))
            told, held, follows = out(columns, follows, False)
            yield told
        yield out(held, follows, True)[0]

    def differing(bits: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return sum((np.bitwise_count(x[a] ^ x[b]).astype(np.int64) for x in bits), np.zeros(len(a), np.int64))

    @tidy
    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a key's rows that lie in different components and may be near copies. Rows come sorted by key and component; of a pair of blocks, only rows of both meet."""
        for x in whole_keys(batches):
            run, root, node, n, at = (x.column(c).to_numpy() for c in ("run", "root", "node", "n", "at"))
            own, alone = x.column("own").to_numpy(), x.column("alone").to_numpy(zero_copy_only=False)
            sketch, parity = ([x.column(c).to_numpy().view(np.uint64) for c in names] for names in (words_, parities_))
            ends = np.append(np.flatnonzero(run[1:] != run[:-1]) + 1, len(run))
            end = ends[np.searchsorted(ends, np.arange(len(run)), side="right")]
            turns = np.append(np.flatnonzero((run[1:] != run[:-1]) | (root[1:] != root[:-1])) + 1, len(run))
            other = turns[np.searchsorted(turns, np.arange(len(run)), side="right")]
            left = np.arange(len(run))
            while len(left := left[other[left] < end[left]]):
                right = other[left]
                hit = alike(n[left], at[left], n[right], at[right], similarity) & (alone[left] | (own[left] != own[right]))
                a, b = left[hit], right[hit]
                near = differing(parity, a, b) <= most_apart(n[a], n[b], similarity)
                a, b = a[near], b[near]
                near = (np.minimum(n[a], n[b]) < LEAST_SKETCHED) | (differing(sketch, a, b) <= most)
                a, b = node[a[near]], node[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                other[left] += 1

    @tidy
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def runs_of_node(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[node] = ordered(text.as_py())
            return sets[node]

        for batch in batches:
            kept = np.zeros(len(batch), bool)
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = runs_of_node(a, batch.column(2)[k]), runs_of_node(b, batch.column(3)[k])
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                kept[k] = shared >= similarity * (len(x) + len(y) - shared) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(kept))

    most = sketch_distance(similarity, deviations=DEVIATIONS)
    words_, parities_ = [f"fp{k}" for k in range(SKETCH_WORDS)], [f"parity{k}" for k in range(PARITY_WORDS)]

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that parities and sketches leave open."""
        told = nodes.select("node", "n", *words_, *parities_)
        a, b = (told.toDF(end, *(f"{end}_{c}" for c in told.columns[1:])) for end in "ab")

        def apart(columns: list[str]) -> Column:
            return sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in columns), F.lit(0))

        both = F.col("a_n") + F.col("b_n")
        near = apart(parities_) <= both - 2 * F.ceil(similarity / (1 + similarity) * both - 1e-9)
        return pairs.join(a, "a").join(b, "b").where(near & ((F.least("a_n", "b_n") < LEAST_SKETCHED) | (apart(words_) <= most))).select("a", "b")

    def decided(likely: DataFrame, work: Scratch) -> DataFrame:
        """The pairs that are similar enough by their whole sets, which are made again from the texts of these nodes alone."""
        ends = work.table(likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct(), "ends")
        wanted = work.table(nodes.join(ends, "node", "left_semi").select("node", F.col("least").alias("doc_id"), "text_key"), "wanted")
        texts = work.table(keyed.join(few(wanted), ["doc_id", "text_key"]).select("node", "text"), "texts")
        if texts.count() > ends.count():  # rows with the same id and text
            texts = work.table(texts.dropDuplicates(["node"]), "texts")
        met = likely.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return work.table(met.select("a", "b", "text_a", "text_b").mapInArrow(similar, "a long, b long"), "links")

    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType())])
    schema = T.StructType([*schema, *(T.StructField(c, T.LongType()) for c in (*words_, *parities_)), T.StructField("first", T.BinaryType())])
    with Scratch(spark) as work:
        prints = work.table(keyed.mapInArrow(first_runs, schema), "prints")
        nodes = work.table(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min_by("text_key", "doc_id").alias("text_key"), *(F.first(c).alias(c) for c in ("n", *words_, *parities_))), "nodes")
        keys = prints.where("doc_id IS NOT NULL").select("node", "n", "first").mapInArrow(keys_of, "run long, node long, n int, at int")
        met = work.table(keys.repartition("run").sortWithinPartitions("run", "n", "node").mapInArrow(met_rows, "run long, node long, n int, at int, next long"), "met")
        sweep(spark)
        close = hamming_links(nodes.where("least IS NOT NULL").select(F.col("fp0").alias("fp"), "node"), COPY_RADIUS, work=work)
        # of the rows that follow a set under its keys, the most frequent one and one more: two pairs a set, however large its group is
        follows = met.where("next IS NOT NULL").groupBy("node", "next").count().groupBy("node").agg(F.max_by("next", "count").alias("most"), F.min("next").alias("least"))
        next_ = follows.select("node", F.explode(F.array_distinct(F.array("most", "least"))).alias("next"))
        pairs = next_.select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).unionByName(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
        first = work.table(pairs.distinct(), "pairs")
        links = decided(work.table(likely_pairs(first), "likely"), work)
        sweep(spark)
        placed = work.table(met.join(components(links, work), "node", "left").select("run", "node", "n", "at", F.coalesce("root", "node").alias("root")), "placed")
        split = placed.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / bucket_rows).alias("blocks")).where("low < high").select("run", "blocks")
        own, met_ = F.pmod(F.xxhash64("node"), "blocks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = placed.join(split, "run").withColumn("own", own).withColumn("met", met_).withColumn("alone", F.expr("own = met"))
        dealt = dealt.withColumn("run", F.when(F.col("blocks") == 1, F.col("run")).otherwise(F.xxhash64("run", F.least("own", "met"), F.greatest("own", "met"))))
        told = nodes.select("node", *words_, *parities_)
        crossed = dealt.select("run", "root", "node", "n", "at", "own", "alone").join(told, "node").repartition("run").sortWithinPartitions("run", "root", "node").mapInArrow(crossing, "a long, b long").distinct()
        more = decided(work.table(crossed.join(first, ["a", "b"], "left_anti"), "pairs"), work)
        sweep(spark)
        roots = components(links.unionByName(more), work)
        placed = work.table(nodes.join(roots, "node", "left").select("node", "least", "text_key", F.coalesce("root", "node").alias("root")), "roots")
        best = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("text_key", "least").alias("kept_key"))
        known = work.table(placed.join(best, "root").select("node", "component_id", "kept_key"), "components")
        kept = (F.col("doc_id") == F.col("component_id")) & (F.col("text_key") == F.col("kept_key"))
        return materialize(prints.select("doc_id", "text_key", "node").join(known, "node").select("doc_id", "text_key", "component_id", F.coalesce(kept, F.lit(False)).alias("kept")), "copies")
