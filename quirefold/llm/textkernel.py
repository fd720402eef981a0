"""Vectorised text primitives shared by the operators of this subpackage.

A column of strings becomes one array of code points with document offsets; words,
pieces and n-grams are then array expressions, so no Python loop runs per character
or per word.  Null texts count as empty texts everywhere.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3, 4
CHUNK_CHARS = 1 << 18
#: Rows of a batch whose texts are held as Python strings at a time.
SLICE_ROWS = 2048
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def char_class() -> np.ndarray:
    """Class of every code point: letter, number, white space, mark or other."""
    if "class" not in _tables:
        t = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(0x30000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                t[c] = LETTER
            elif k == "N":
                t[c] = NUMBER
            elif k == "M":
                t[c] = MARK
        t[0x30000:0x323B0] = LETTER
        for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)):
            t[c] = SPACE
        _tables["class"] = t
    return _tables["class"]


def lower_table() -> np.ndarray:
    """One-to-one lower case of every code point."""
    if "lower" not in _tables:
        t = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        for c in range(0x1F000):
            low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
            if len(low) == 1:
                t[c] = ord(low)
        _tables["lower"] = t
    return _tables["lower"]


def upper_mask() -> np.ndarray:
    """True for code points that have another lower case."""
    if "upper" not in _tables:
        _tables["upper"] = lower_table() != np.arange(sys.maxunicode + 1, dtype=np.uint32)
    return _tables["upper"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) <= n:
        size = max(n + 1, CHUNK_CHARS + 1)
        for name, base in (("pow", _P), ("inv", _PINV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Consecutive documents: code points, and where each document begins among them."""

    rows: slice
    cp: np.ndarray
    off: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.off) - 1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value per character, by document."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


def strings(column: pa.Array) -> list[str]:
    """Values of a string column; null becomes the empty string."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, without a copy; an empty batch stays."""
    for b in batches:
        for i in range(0, max(b.num_rows, 1), rows):
            yield b.slice(i, rows)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[Chunk]:
    """Runs of documents of up to so many characters; a longer document is a run by itself."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        part = texts[begin:end]
        off = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(x) for x in part], out=off[1:])
        cp = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        yield Chunk(slice(begin, end), cp, off)
        begin = end


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of members that stays within one document."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(member), bool)
    before[0] = False
    before[1:] = member[:-1]
    inner = off[1:-1]
    inner = inner[inner < len(member)]
    before[inner] = False
    begin = np.flatnonzero(member & ~before)
    after = np.empty(len(member), bool)
    after[-1] = False
    after[:-1] = member[1:]
    last = inner[inner > 0] - 1
    after[last] = False
    return begin, np.flatnonzero(member & ~after) + 1


def span_hash(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points: a polynomial by prefix sums, then mixed with the length."""
    power, inverse = _powers(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))


@dataclass
class Words:
    """Words of a chunk: where each begins and ends, its document, and its hash."""

    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def words(chunk: Chunk) -> Words:
    """Lower-cased runs of letters, marks and digits, in order of the text."""
    kind = char_class()[chunk.cp]
    begin, end = runs((kind == LETTER) | (kind == NUMBER) | (kind == MARK), chunk.off)
    found = span_hash(lower_table()[chunk.cp], begin, end)
    return Words(begin, end, found, np.searchsorted(begin, chunk.off))


def word_list(text: str | None) -> list[str]:
    """The same words as strings, one character at a time; for tests and small inputs."""
    out, now = [], []
    for c in text or "":
        if char_class()[ord(c)] in (LETTER, NUMBER, MARK):
            now.append(chr(lower_table()[ord(c)]))
        elif now:
            out.append("".join(now))
            now = []
    return out + (["".join(now)] if now else [])


def hash_word(word: str) -> int:
    """Hash that ``words`` gives this word, given in lower case."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return int(span_hash(codes, np.array([0]), np.array([len(codes)]))[0])


def ngram_hash(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values of one sequence."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total * _P + w[k : len(w) - n + 1 + k])
    return total
