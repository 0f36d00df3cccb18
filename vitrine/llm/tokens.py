"""Encoding whole texts with a public tokenizer, a distinct word at a time."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The characters of Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"

# Latin letters that Unicode normalisation leaves alone and whose lower case is one letter.
LATIN = "A-Za-zÀ-ÖØ-öø-įıĲ-ɏ"

#: Words a worker remembers in each of two generations (about 150 bytes each).
CACHE_WORDS = 200_000


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes as: printable ones stay, others count up from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by the tokenizers library.

    A pre-tokenizer that splits before white space that follows a visible character, and between a letter
    and ASCII punctuation, gives each such stretch (white space with a word, or marks) the same ids inside a text as alone. So each distinct
    stretch of a batch is encoded once and remembered; texts are joined from these. A stretch
    that is one plain Latin word is one pre-token and goes to the library's model at once, others through
    its whole encoding. Both files used here split that way; the tests hold them against encoding whole texts.
    A text that holds the string of an added token (one for the end of a text, say) goes through the library whole, which gives that token's id.
    """

    def __init__(self, vocabulary: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        # what is matched in the normalised text could come from any text; case counts, but not for texts that are lower-cased here
        self.marked = re.compile("" if any(t.normalized for t in added) else "|".join(re.escape(t.content) for t in added) or "(?!)", re.IGNORECASE).search
        self.limit = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.letters = byte_letters()
        self.lower = self._whole("Ab") == self._whole("ab")
        self.drops_space = self._whole(" ") == b""
        word, other = f"[{LATIN}]+(?=[!-@\\[-`{{-~{WHITE}]|$)", f"[^{WHITE}]+"
        self.stretches = re.compile(f"{word}|{other}" if self.drops_space else f"[{WHITE}]*{word}|[{WHITE}]*{other}|[{WHITE}]+").findall
        self.plain = re.compile(f" ?[{LATIN}]+").fullmatch
        if any(self._word(w) != self._whole(w) for w in ("a", " a", "Word", " Straße", " élève", "ñandú")):
            self.plain = lambda w: None

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if self.drops_space:
            word = word.lstrip(" ")
        if self.lower:
            word = word.lower()
        spelt = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cased(self, text: str) -> str:
        """Lower case at once, where the vocabulary has no other and each letter has one of its own."""
        if self.lower:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            return text.lower()
        return text

    def __call__(self, texts: list[str | None], end_id: int | None = None) -> list[bytes]:
        """The ids of each text (null: none), then end_id if there is one."""
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        marked = {k: self._whole(x) for k, x in enumerate(texts) if x and self.marked(x)}
        split = [[] if k in marked else self.stretches(self._cased(x or "")) for k, x in enumerate(texts)]
        young, old = self.young, self.old
        new = set().union(*split).difference(young)
        for w in new & old.keys():
            young[w] = old[w]
        for w in new.difference(young):
            young[w] = self._word(w) if self.plain(w) else self._whole(w)
        found = [marked.get(k, b"") + b"".join(map(young.__getitem__, x)) + end for k, x in enumerate(split)]
        if len(young) > self.limit:
            self.old, self.young = young, {}
        return found


@lru_cache(maxsize=2)
def encoder(vocabulary: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """One for each file and worker; later tasks of the worker find the words that are known."""
    return WordEncoder(vocabulary, cache_words)


def text_lengths(texts: pa.Array) -> list[int]:
    """Characters of each text (null: none), without making them Python's."""
    return pc.fill_null(pc.utf8_length(texts), 0).to_pylist()


def runs_of(lengths: list[int], most: int):
    """Slices of consecutive texts with at most `most` characters together, one text at least."""
    begin, held = 0, 0
    for k, n in enumerate(lengths):
        if k > begin and held + n > most:
            yield slice(begin, k)
            begin, held = k, 0
        held += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))
