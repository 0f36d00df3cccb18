"""Benchmark decontamination by canonical templates: copies, and questions with other numbers, names or units."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.tokens import runs_of, text_lengths
from vitrine.llm.workers import tidy

#: Words of a window.
WINDOW = 5
#: Least share of an item's windows that a document must have.
SIMILARITY = 0.8
#: Least share of an item's tokens that a stretch of a document must repeat place by place, if it has a window of the item.
ALIGNED = 0.9
#: Words besides placeholders that an item needs to match with other values; with fewer it must stand there with its own ones.
SHORT_WORDS = 3
#: Pairs of a window in the benchmark and one in a task's texts that are held at a time, but for those of a single item.
MOST_HITS = 1 << 20
#: Benchmark text that is indexed and broadcast at a time; a larger benchmark takes a pass over the documents for each such block.
BLOCK_BYTES = 16 << 20
#: Words a task handles at a time, and remembers.
RUN_WORDS = 1 << 17
CACHE_WORDS = 100_000

# Units that may follow a number.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg lb lbs oz ounce ounces t ton tons ml l liter liters litre litres gal gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh kph hz khz mhz ghz w kw v a j kj cal kcal c f k % percent $ usd dollar dollars eur euro euros gbp pound pounds cent cents".split())

NAME, NUMBER, UNIT, FIRST_WORD = 1, 2, 3, 4
_IS_NUMBER, _IS_UNIT, _IS_CAPITAL, _ENDS = 1, 2, 4, 8
_MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’*_`~#&|…-–—/\\"


class Words(dict):
    """word -> code << 4 | flags. Codes number the vocabulary's lower-cased bare words from FIRST_WORD; other words have 0, or get the next one if the vocabulary is open."""

    def __init__(self, vocabulary: dict[str, int], is_open: bool = False):
        super().__init__()
        self.vocabulary = vocabulary
        self.is_open = is_open

    def __missing__(self, word: str) -> int:
        bare = word.strip(_MARKS)
        low = bare.lower()
        code = self.vocabulary.get(low, 0)
        if not code and self.is_open:
            code = self.vocabulary[low] = FIRST_WORD + len(self.vocabulary)
        number = bare.lstrip("+-$€£")[:1].isdigit() if bare else False
        flags = _IS_NUMBER * number | _IS_UNIT * (low in UNITS) | _IS_CAPITAL * bare[:1].isupper() | _ENDS * (word.rstrip("\"'»“”’)]")[-1:] in (".", "!", "?"))
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = code << 4 | flags
        return value


@dataclass
class Templates:
    """Texts as typed tokens, joined: code of each token, that of its word itself, the place of its word in the words, and where each text begins (and the last ends)."""

    code: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    begin: np.ndarray


def templates(split: list[list[str]], words: Words) -> Templates:
    """Each text's words with placeholders for what may be exchanged.

    A word that begins with a digit is a number; a unit right after one is a unit; a capitalised word is a name unless a sentence
    (or the text) begins with it, and names in a row are one. Case and marks around words don't count.
    """
    sizes = np.array([len(x) for x in split], np.int64)
    value = np.fromiter((words[w] for x in split for w in x), np.int64, sizes.sum())
    code, flags = value >> 4, value & 15
    first = np.zeros(len(value) + 1, bool)
    first[np.cumsum(sizes) - sizes] = True
    first = first[:-1]
    after = np.concatenate([[0], flags[:-1]])
    number = flags & _IS_NUMBER > 0
    name = (flags & _IS_CAPITAL > 0) & ~first & (after & _ENDS == 0) & ~number
    unit = (flags & _IS_UNIT > 0) & ~first & np.concatenate([[False], number[:-1]]) & ~number
    raw, code = code, np.select([number, unit, name], [NUMBER, UNIT, NAME], code)
    kept = ~(name & np.concatenate([[False], name[:-1]]))
    owner = np.repeat(np.arange(len(split)), sizes)[kept]
    return Templates(code[kept], raw[kept], np.flatnonzero(kept), np.searchsorted(owner, np.arange(len(split) + 1)))


def window_hashes(t: Templates, window: int, literal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, text) of every window that lies in one text, holds no unknown word and has a word besides placeholders; with `literal`, of the words as they are."""
    code = t.raw if literal else t.code
    n = len(code) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (code.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    known, worded = np.ones(n, bool), np.zeros(n, bool)
    for k in range(window):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
        known &= code[k : k + n] != 0
        worded |= code[k : k + n] >= FIRST_WORD
    owner = np.repeat(np.arange(len(t.begin) - 1), np.diff(t.begin))
    at = np.flatnonzero(known & worded & (owner[:n] == owner[window - 1 :]))
    return h[at], at, owner[at]


@dataclass
class Layer:
    """Items' windows of `window` tokens, by hash: those of hashes[k] are item[starts[k] : starts[k + 1]], at these places. literal: of words as they are."""

    window: int
    literal: bool
    hashes: np.ndarray
    starts: np.ndarray
    item: np.ndarray
    place: np.ndarray

    def of(self, first: int, last: int) -> Layer:
        """The windows of the items from `first` to `last` - 1."""
        own = (self.item >= first) & (self.item < last)
        starts = np.concatenate([[0], np.cumsum(own)])[self.starts]
        return Layer(self.window, self.literal, self.hashes, starts, self.item[own], self.place[own])


@dataclass
class Index:
    """A block of the benchmark: its windows by hash (a layer for each length), and its words for checking slots.

    literal: items that have too few words to be found with other values. bare_place: the places of windows of placeholders alone in the other items, item by
    item from bare_begin[k] on; no hash leads to them, they count where windows with words put the item.
    """

    items: list
    vocabulary: dict[str, int]
    split: list[list[str]]
    tokens: Templates
    layers: list[Layer] = field(default_factory=list)
    windows: np.ndarray = field(default=None)
    literal: np.ndarray = field(default=None)
    bare_begin: np.ndarray = field(default=None)
    bare_place: np.ndarray = field(default=None)

    @property
    def sizes(self) -> np.ndarray:
        """Each item's tokens."""
        return np.diff(self.tokens.begin)


def index_items(rows: list[tuple[object, str]], window: int) -> Index:
    """The index of (item id, text) rows. An item of fewer tokens than a window has one window of all its tokens; one without a word has none."""
    words = Words({}, is_open=True)
    split = [(text or "").split() for _, text in rows]
    tokens = templates(split, words)
    index = Index([i for i, _ in rows], words.vocabulary, split, tokens, windows=np.zeros(len(rows), np.int64))
    sizes = index.sizes
    owner = np.repeat(np.arange(len(rows)), sizes)
    index.literal = np.bincount(owner[tokens.code >= FIRST_WORD], minlength=len(rows)) < SHORT_WORDS
    for n in range(1, window + 1):
        for literal in (False, True):
            h, at, own_item = window_hashes(tokens, n, literal)
            own = ((sizes[own_item] == n) | (n == window)) & (index.literal[own_item] == literal)
            h, at, own_item = h[own], at[own], own_item[own]
            if len(h):
                order = np.argsort(h, kind="stable")
                hashes, starts = np.unique(h[order], return_index=True)
                index.layers.append(Layer(n, literal, hashes, np.append(starts, len(h)), own_item[order], (at - tokens.begin[own_item])[order]))
    index.windows = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
    n = max(len(owner) - window + 1, 0)
    bare = np.all([tokens.code[k : k + n] < FIRST_WORD for k in range(window)], 0) & (owner[:n] == owner[window - 1 :]) & ~index.literal[owner[:n]] if n else np.zeros(0, bool)
    at = np.flatnonzero(bare)
    index.bare_begin, index.bare_place = np.searchsorted(owner[at], np.arange(len(rows) + 1)), at - tokens.begin[owner[at]]
    return index


class Slots:
    """Which values of a document stand for an item's: one for each throughout, and for names also the other way round."""

    def __init__(self, index: Index, item: int, doc_words: list[str], doc: Templates, first: int):
        self.tokens, self.begin, self.item_words = index.tokens, index.tokens.begin[item], index.split[item]
        self.doc_words, self.doc, self.first = doc_words, doc, first
        self.forward: dict[tuple[int, str], tuple[int, str]] = {}
        self.back: dict[tuple[int, str], tuple[int, str]] = {}

    def take(self, place: int, at: int, n: int) -> bool:
        """Whether the values of `n` tokens from `place` in the item and `at` in the documents fit what was taken; if so they are taken too."""
        bare = lambda w: w.strip(_MARKS).lower()
        new_f, new_b = {}, {}
        for k in range(n):
            kind = int(self.tokens.code[self.begin + place + k])
            if kind < FIRST_WORD:
                a = kind, bare(self.item_words[self.tokens.at[self.begin + place + k] - self.tokens.at[self.begin]])
                b = kind, bare(self.doc_words[self.doc.at[at + k] - self.first])
                if self.forward.get(a, new_f.setdefault(a, b)) != b or (kind == NAME and self.back.get(b, new_b.setdefault(b, a)) != a):
                    return False
        self.forward |= new_f
        self.back |= new_b
        return True

    @property
    def changed(self) -> bool:
        return any(a != b for a, b in self.forward.items())


def covered(places: list[int], window: int) -> int:
    """Tokens in windows at these places (ascending)."""
    return sum(min(window, b - a) for a, b in zip(places, places[1:], strict=False)) + window * bool(places)


def consistent(slots: Slots, place: np.ndarray, at: np.ndarray, window: int, windows: int) -> set[int]:
    """The places of the item's `windows` windows that fit together.

    place in the item, at: token of the documents. Windows are taken by how many lie on the same shift, and those whose slots
    contradict what was taken are left out. When all are taken, the other shifts can't add any.
    """
    _, shift, n = np.unique(at - place, return_inverse=True, return_counts=True)
    taken: set[int] = set()
    for k in np.lexsort((at, shift, -n[shift])).tolist():
        if len(taken) == windows:
            break
        p = int(place[k])
        if p not in taken and slots.take(p, int(at[k]), window):
            taken.add(p)
    return taken


def hits(doc: Templates, index: Index, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text x items + item, place in the item, token) of every window that a text shares with an item, in order, for a stretch of the items at a time.

    Stretches have about MOST_HITS pairs: how many each item has is told by its windows' occurrences before any pair is made.
    """
    met = []
    each = np.zeros(len(index.items), np.int64)
    for layer in index.layers:
        h, at, owner = window_hashes(doc, layer.window, layer.literal)
        if not len(h):
            continue
        slot = np.minimum(np.searchsorted(layer.hashes, h), len(layer.hashes) - 1)
        hit = layer.hashes[slot] == h
        slot, at, owner = slot[hit], at[hit], owner[hit]
        often = np.bincount(slot, minlength=len(layer.hashes))
        each += np.bincount(layer.item, np.repeat(often, np.diff(layer.starts)), len(index.items)).astype(np.int64)
        met.append((layer, slot, at, owner))
    stretch = (np.cumsum(each) - 1) // MOST_HITS if each.sum() > MOST_HITS else np.zeros(len(each), np.int64)
    begins = np.flatnonzero(np.diff(stretch, prepend=-1)) if each.any() else np.zeros(0, np.int64)
    for first, last in zip(begins, [*begins[1:], len(each)][: len(begins)], strict=True):
        out = []
        for layer, slot, at, owner in met:
            own = layer if len(begins) == 1 else layer.of(first, last)
            n = own.starts[slot + 1] - own.starts[slot]
            posting = np.repeat(own.starts[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(owner, n) * len(index.items) + own.item[posting], own.place[posting], np.repeat(at, n)))
        pair, place, at = (np.concatenate(x) for x in zip(*out, strict=True))
        if not len(pair):
            continue
        bare = _bare_hits(pair, place, at, doc, index, window)
        pair, place, at = (np.concatenate(x) for x in zip((pair, place, at), bare, strict=True))
        order = np.lexsort((at, place, pair))
        yield pair[order], place[order], at[order]


def _lines(pair: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The distinct (pair, shift), in order: shape (n, 2)."""
    least = int(shift.min())
    wide = int(shift.max()) - least + 1
    return np.stack(np.divmod(np.unique(pair * wide + (shift - least)), wide), 1) + np.array([0, least])


def _bare_hits(pair: np.ndarray, place: np.ndarray, at: np.ndarray, doc: Templates, index: Index, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of placeholders alone that stand where others put their items."""
    none = (np.zeros(0, np.int64),) * 3
    item = pair % len(index.items)
    some = index.bare_begin[item + 1] > index.bare_begin[item]
    if not some.any():
        return none
    lines = _lines(pair[some], at[some] - place[some])
    out = [none]
    for k in range(0, len(lines), RUN_WORDS // window):
        own, shift = lines[k : k + RUN_WORDS // window].T
        text, item = np.divmod(own, len(index.items))
        n = index.bare_begin[item + 1] - index.bare_begin[item]
        spot = index.bare_place[np.repeat(index.bare_begin[item] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        text, item, own, start = (np.repeat(x, n) for x in (text, item, own, shift))
        start = start + spot
        fits = (start >= doc.begin[text]) & (start + window <= doc.begin[text + 1])
        for j in range(window):
            fits &= doc.code[np.where(fits, start + j, 0)] == index.tokens.code[index.tokens.begin[item] + spot + j]
        out.append((own[fits], spot[fits], start[fits]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def aligned(pair: np.ndarray, shift: np.ndarray, doc: Templates, index: Index) -> np.ndarray:
    """How many tokens of the item each pair has in common on its shift (the token of the documents where the item would begin)."""
    text, item = np.divmod(pair, len(index.items))
    n = index.sizes[item]
    start = np.cumsum(n) - n
    k = np.arange(n.sum()) - np.repeat(start, n)
    at = np.repeat(shift, n) + k
    inside = (at >= np.repeat(doc.begin[text], n)) & (at < np.repeat(doc.begin[text + 1], n))
    at, own = np.where(inside, at, 0), np.repeat(index.tokens.begin[item], n) + k
    same = inside & np.where(np.repeat(index.literal[item], n), doc.raw[at] == index.tokens.raw[own], doc.code[at] == index.tokens.code[own])
    return np.add.reduceat(same.astype(np.int64), start)


def matches(texts: list[str | None], index: Index, words: Words, window: int, similarity: float) -> Iterator[tuple[int, int, int, bool]]:
    """(text, item, windows found, whether slots changed) of every text with enough of an item (see find_leaks())."""
    split = [(x or "").split() for x in texts]
    doc = templates(split, words)
    firsts = np.cumsum([0] + [len(x) for x in split])
    for pair, place, at in hits(doc, index, window):
        yield from _judged(pair, place, at, split, firsts, doc, index, window, similarity)


def _judged(pair: np.ndarray, place: np.ndarray, at: np.ndarray, split: list[list[str]], firsts: np.ndarray, doc: Templates, index: Index, window: int, similarity: float) -> Iterator[tuple[int, int, int, bool]]:
    """What matches() tells of the items that a stretch of hits() has."""
    groups, begin = np.unique(pair, return_index=True)
    ends = np.append(begin[1:], len(pair))
    item, sizes = groups % len(index.items), index.sizes
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
    found = np.add.reduceat(fresh.astype(np.int64), begin)
    # what a window adds to the tokens in the windows before it
    wide = np.minimum(window, sizes[pair % len(index.items)])
    adds = wide.copy()
    inner = np.flatnonzero(pair[1:] == pair[:-1]) + 1
    adds[inner] = np.minimum(wide[inner], place[inner] - place[inner - 1])
    enough = (found >= similarity * index.windows[item]) | (np.add.reduceat(adds, begin) >= similarity * sizes[item])
    lines = _lines(pair, at - place)
    # ever so many of them at a time
    step = max(1, RUN_WORDS // max(1, int(sizes.max())))
    whole = np.concatenate([aligned(*x.T, doc, index) for x in (lines[k : k + step] for k in range(0, len(lines), step))])
    lines = lines[whole >= ALIGNED * sizes[lines[:, 0] % len(index.items)]]
    lines_from, lines_to = (np.searchsorted(lines[:, 0], groups, side).tolist() for side in ("left", "right"))
    for g, a, b, likely, c, d in zip(groups.tolist(), begin.tolist(), ends.tolist(), enough.tolist(), lines_from, lines_to, strict=True):
        if not likely and c == d:
            continue
        text, own = divmod(g, len(index.items))
        n = int(sizes[own])
        if n < window:
            # each of the places where all of it stands, as another may have the item's own values
            fixed = int((index.tokens.code[index.tokens.begin[own] : index.tokens.begin[own + 1]] >= FIRST_WORD).sum())
            told = []
            for t in at[a:b].tolist():
                slots = Slots(index, own, split[text], doc, firsts[text])
                if slots.take(0, t, n) and (fixed >= SHORT_WORDS or not slots.changed):
                    told.append(slots.changed)
                    if not slots.changed:
                        break
            if told:
                yield text, own, 1, all(told)
            continue
        slots = Slots(index, own, split[text], doc, firsts[text])
        taken = consistent(slots, place[a:b], at[a:b], window, int(index.windows[own]))
        if len(taken) >= similarity * index.windows[own] or covered(sorted(taken), window) >= similarity * n:
            yield text, own, len(taken), slots.changed
            continue
        here, there = (doc.raw, index.tokens.raw) if index.literal[own] else (doc.code, index.tokens.code)
        for shift in lines[c:d, 1].tolist():
            slots = Slots(index, own, split[text], doc, firsts[text])
            lo, hi = doc.begin[text], doc.begin[text + 1]
            same = [k for k in range(n) if lo <= shift + k < hi and here[shift + k] == there[index.tokens.begin[own] + k] and slots.take(k, shift + k, 1)]
            if len(same) >= ALIGNED * n:
                yield text, own, len(taken), slots.changed
                break


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of stretches with about RUN_WORDS words."""
    for run in runs_of([n // 5 for n in text_lengths(texts)], RUN_WORDS):
        yield run.start, texts.slice(run.start, run.stop - run.start).to_pylist()


def blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Index]:
    """Indices of the benchmark's items, of about `block_bytes` of text each; together they have every item with a text."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        yield index_items([(r["item_id"], r["text"]) for r in own.toLocalIterator()], window)


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, changed) for every document with enough of an item.

    That is `similarity` of its template windows, or windows that hold `similarity` of its tokens, or a stretch that has ALIGNED of its tokens in
    their places, so that an item with a word exchanged is found. An item of fewer tokens than a window must stand there whole, and one without SHORT_WORDS words besides
    placeholders with its own values: any column of figures has the template of a few numbers. Windows of placeholders alone count where windows with words put the item.
    Both sides' numbers, units and names become placeholders; windows of `window` tokens meet in a hash join with the broadcast
    block of the benchmark, and the values behind the placeholders must fit together. changed tells a re-parameterised copy from
    a plain one; n_found counts intact windows that fit. Long texts pass whole; pairs of windows are made for a stretch of the items at a time. Null texts match nothing; repeated documents or items give rows of their own; with an empty table there are no rows.
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("n_windows", T.LongType()), T.StructField("n_found", T.LongType()), T.StructField("changed", T.BooleanType())])
    found = spark.createDataFrame([], schema)
    for index in blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        @tidy
        def leaks(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            words = Words(own.vocabulary)
            for batch in batches:
                rows = [(start + k, own.items[i], int(own.windows[i]), n, changed) for start, texts in _runs(batch.column(1)) for k, i, n, changed in matches(texts, own, words, window, similarity)]
                at, *rest = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, t) for x, t in zip(rest, (None if rows else pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))], names=[f.name for f in schema])

        found = found.unionByName(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(leaks, schema))
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` without the rows that find_leaks() reports, all columns as they were; no row is shuffled."""
    spark = docs.sparkSession
    text_at = docs.columns.index(text_col)
    for index in blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        @tidy
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            words = Words(own.vocabulary)
            for batch in batches:
                kept = np.ones(len(batch), bool)
                for start, texts in _runs(batch.column(text_at)):
                    for k, *_ in matches(texts, own, words, window, similarity):
                        kept[start + k] = False
                yield batch.filter(pa.array(kept))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
