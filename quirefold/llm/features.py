"""Counts of a text's surface: characters by kind, words, repeats and lines."""

from __future__ import annotations

import unicodedata

import numpy as np

from . import textkernel as K

SYMBOLS = "#$%&*|!<>{}=~^@_\\"
NAMES = ["n_chars", "n_letters", "n_upper", "n_numbers", "n_symbols", "n_spaces", "n_words", "n_repeats", "n_types", "n_lines", "n_repeated_lines", "n_word_chars"]
_tables: dict[str, np.ndarray] = {}


def _bits() -> np.ndarray:
    """Bit 0: upper case (Lu); bit 1: symbol."""
    if "bits" not in _tables:
        t = np.zeros(len(K.char_class()), np.uint8)
        t[[c for c in range(0x1F000) if unicodedata.category(chr(c)) == "Lu"]] = 1
        t[[ord(c) for c in SYMBOLS]] |= 2
        _tables["bits"] = t
    return _tables["bits"]


def _distinct(doc: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
    """Number of distinct values in each document; ``doc`` ascends."""
    out = np.zeros(docs, np.int64)
    ends = np.searchsorted(doc, np.arange(docs + 1))
    for i in range(docs):
        v = np.sort(value[ends[i] : ends[i + 1]])
        out[i] = len(v) and 1 + np.count_nonzero(v[1:] != v[:-1])
    return out


def measure(c: K.Chunk, w: K.Words) -> np.ndarray:
    """The counts named in ``NAMES``, a row for each document of a chunk.

    ``n_repeats`` counts words equal to the word before them, ``n_repeated_lines`` lines whose text came earlier in
    the document.
    """
    kind, bits, doc = K.char_class()[c.cp], _bits()[c.cp], w.doc()
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    word_sum = lambda v: np.bincount(doc, v, c.docs).astype(np.int64)
    begin, end = K.runs(c.cp != 10, c.off)
    line_doc = np.searchsorted(c.off, begin, side="right") - 1
    lines = np.bincount(line_doc, minlength=c.docs)
    return np.stack([
        np.diff(c.off), c.per_doc(kind == K.LETTER), c.per_doc(bits & 1), c.per_doc(kind == K.NUMBER), c.per_doc(bits >> 1), c.per_doc(kind == K.SPACE),
        np.diff(w.off), word_sum(same), _distinct(doc, w.hash, c.docs), lines, lines - _distinct(line_doc, K.span_hash(c.cp, begin, end), c.docs), word_sum(w.end - w.begin),
    ], axis=1)


def measure_texts(texts: list[str]) -> np.ndarray:
    """The counts of each text in turn."""
    parts = [measure(c, K.words(c)) for c in K.chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)), np.int64)
