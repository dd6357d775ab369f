"""Token ids of a byte-level BPE vocabulary, with bounded caches over blank-separated chunks.

A byte-level tokenizer of this kind never lets a token cross from one blank-separated chunk
into the next as long as single spaces and single line feeds are the only blanks. Texts like
that are cut at them, and new chunks once more where the vocabulary's own splitter cuts (words,
numbers, punctuation), so "and," reuses "and"; all other texts go to the tokenizer whole. Ids come
as little-endian unsigned 32-bit bytes, ready to be joined.
"""

from __future__ import annotations

import array
import string
import sys

import regex

CACHE_ENTRIES = 400_000
#: Fixed value: how byte-level vocabularies of this kind split a text.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKS = frozenset(string.punctuation)
#: Characters whose class is the same in every version of the character tables.
SETTLED = regex.compile("[\x00-\u04ff]*")


class _Odd(Exception):
    """A chunk that single blanks cannot have left."""


def _alphabet() -> dict[int, str]:
    """The printable stand-in of every byte, a rule of byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    return table | {b: chr(256 + i) for i, b in enumerate(hidden)}


def packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Recent(dict):
    """A cache of two generations: when the younger is full it replaces the older, and what is
    still used comes back from there."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)  # may come back here for the parts of the key
        if len(self) >= self.limit:
            self.older = self.copy()
            self.clear()
        self[key] = found
        return found


class Encoder:
    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.cut = self.tokenizer.model, regex.compile(SPLITTER).findall
        self.table = str.maketrans({chr(b): c for b, c in _alphabet().items()})
        self.blank = self.table[32]
        self.parts = Recent(self._part, limit)
        self.chunks = Recent(self._chunk, limit)

    def _part(self, part: str) -> bytes:
        """Ids of one unit of the vocabulary's splitter."""
        shown = part.encode().decode("latin-1").translate(self.table)
        return packed([t.id for t in self.model.tokenize(shown)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk: ``word`` stands for a space and the word, ``\\nword`` for itself."""
        if chunk.isalpha():  # letters after a space are one unit
            if chunk.isascii():
                return packed([t.id for t in self.model.tokenize(self.blank + chunk)])
            return self._part(" " + chunk)
        head, mark = chunk[:-1], chunk[-1:]
        if mark in MARKS and head.isalpha():  # so are they before a single mark
            return self.chunks[head] + self.parts[mark]
        if chunk in ("", "\n"):
            raise _Odd
        text = chunk if chunk[0] == "\n" else " " + chunk
        if SETTLED.fullmatch(chunk):
            return b"".join([self.chunks[p[1:]] if p[0] == " " and p[1:].isalpha() else self.parts[p]
                             for p in self.cut(text)])
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        """Ids of the text, 4 bytes each, little-endian."""
        if not text:
            return b""
        if not text.replace("\n", "").isprintable():
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            ids = b"".join(map(self.chunks.__getitem__, rest))
            return self.whole(first) + ids if first else ids
        except _Odd:
            return self.whole(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, made once per process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
