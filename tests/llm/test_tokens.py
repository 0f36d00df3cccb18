from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vitrine.llm.packing import best_fit_pack, cut, pack_documents, plan_best_fit, tokenize_pieces
from vitrine.llm.queries import vocabulary
from vitrine.llm.tokenfile import pack_bits, read_documents, read_ids, unpack_bits, write_token_file
from vitrine.llm.tokens import WordEncoder
from vitrine.sources.shared import shared_path

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def key(row) -> int:
    return -1 if row.doc_id is None else row.doc_id


def whole(name: str, texts: list[str | None]) -> list[list[int]]:
    t = Tokenizer.from_file(vocabulary(name))
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", FILES)
def test_words_give_the_ids_of_whole_texts(texts, name):
    rng = random.Random(2)
    alphabet = "aZz09 .,'!?-_/\\\t\n\r\x0b\x1c\x85\xa0 　éßÑİıſﬁ’“”—😀中한ا́‍@#$%^&*()"
    noise = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(3000)]
    noise += ["don't won't I'll we've 's 're", "a  b   c\n\n\nd \n e", "x's'S", " " * 50 + "a", "1234567 8,900.50", "naïve café Ångström", "CAFÉ ÀÉÎ ÑANDÚ Straße ẞ"]
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "a<|endoftext|>b", " <|endoftext|> <|startoftext|>\n", "x" * 9 + "<|endoftext|>" * 3]
    noise += [rng.choice(noise) + rng.choice(marks) + rng.choice(noise) for _ in range(500)] + marks
    asked = [*texts, *noise]
    encode = WordEncoder(vocabulary(name), cache_words=500)
    for k in range(0, len(asked), 97):
        part = asked[k : k + 97]
        got = [np.frombuffer(x, "<u4").tolist() for x in encode(part, 2)]
        assert got == whole(name, part)


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(best := min(fits))
            rooms.append(best - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used: dict[int, list[tuple[int, int]]] = {}
    seen = []
    for n, a, b, first, offset in plan_best_fit(histogram, capacity):
        for rank in range(a, b):
            seen.append((n, rank))
            used.setdefault(first + rank - a, []).append((offset, n))
    assert sorted(seen) == sorted((n, r) for n, c in histogram.items() for r in range(c))
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(used) == best_fit_decreasing(lengths, capacity)


def test_packing_is_whole(docs):
    rows = pack_documents(docs, vocabulary(FILES[0]), 64, 2, emit="ids").collect()
    want = sorted((key(r), tuple(i)) for r, i in zip(docs.collect(), whole(FILES[0], [r.text for r in docs.collect()]), strict=True))
    by: dict[tuple, list] = {}
    sequences: dict[int, list] = {}
    for r in rows:
        assert 1 <= r.length == len(r.ids) <= 64 and (r.length == 64 or r.piece == 0)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault((key(r), r.start), []).append(tuple(r.ids))
    for x in sequences.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    # rows with one id differ in text here only if they are alike, so their pieces may be taken in any order
    got = []
    for doc in {d for d, _ in by}:
        starts = sorted(s for d, s in by if d == doc)
        for k in range(len(by[(doc, 0)])):
            got.append((doc, tuple(x for s in starts for x in by[(doc, s)][k])))
    assert sorted(got) == want
    tokens = sum(r.length for r in rows)
    assert len(sequences) == best_fit_decreasing([r.length for r in rows], 64) >= -(-tokens // 64)


def test_packing_crc_and_nothing(docs, none):
    rows = tokenize_pieces(docs.where("doc_id = 7"), vocabulary(FILES[0]), 64, 2, emit="crc32").collect()
    ids = whole(FILES[0], [docs.where("doc_id = 7").first().text])[0]
    assert sorted((r.start, r.ids_crc32) for r in rows) == sorted((s, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for s, n in cut(len(ids), 64))
    assert pack_documents(none, vocabulary(FILES[0])).count() == 0
    assert "sequence_id" in best_fit_pack(tokenize_pieces(none, vocabulary(FILES[0]))).columns


def test_special_tokens_have_their_own_ids():
    for name, last in zip(FILES, (50256, 49407), strict=True):
        assert np.frombuffer(WordEncoder(vocabulary(name))(["a <|endoftext|>"], 2)[0], "<u4").tolist()[-2:] == [last, 2]


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bits_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
        packed = pack_bits(ids, width)
        assert len(packed) == -(-n * width // 8)
        assert np.array_equal(unpack_bits(packed, width, n), ids)


def test_token_file_round_trip(spark, docs, none):
    path = shared_path(spark, "t")
    write_token_file(docs, path, vocabulary(FILES[1]), block_ids=50)
    rows = sorted(read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    source = docs.collect()
    want = sorted((key(r), tuple(i)) for r, i in zip(source, whole(FILES[1], [r.text for r in source]), strict=True))
    assert sorted((key(r), tuple(r.ids)) for r in rows) == want
    crcs = {r.start: r.ids_crc32 for r in read_documents(spark, path, emit="crc32").collect()}
    assert crcs == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    every = [i for r in rows for i in r.ids]
    parts = sorted((r.start, r.ids) for r in read_ids(spark, path, 33, 777).collect())
    assert [i for _, x in parts for i in x] == every[33:777]
    empty = shared_path(spark, "t")
    write_token_file(none, empty, vocabulary(FILES[1]))
    assert read_documents(spark, empty).count() == 0
