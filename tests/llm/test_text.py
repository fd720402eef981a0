"""The text kernel against character-by-character versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import features
from quirefold.llm import textkernel as K

from .support import TEXTS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8), st.integers(1, 60))
def test_words(texts, most):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = []
    for c in K.chunks(texts, most):
        w = K.words(c)
        got.extend(w.hash[a:b].tolist() for a, b in zip(w.off[:-1], w.off[1:], strict=True))
    assert got == [[K.hash_word(x) for x in K.word_list(t)] for t in texts]


def test_ngrams_depend_on_order():
    w = np.arange(6, dtype=np.uint64)
    assert len(set(K.ngram_hash(w, 3).tolist())) == 4
    assert K.ngram_hash(w[::-1].copy(), 6)[0] != K.ngram_hash(w, 6)[0]
    assert len(K.ngram_hash(w, 7)) == 0


def test_counts():
    texts = [t or "" for t in TEXTS]
    got = features.measure_texts(texts)
    for row, t in zip(got, texts, strict=True):
        n = dict(zip(features.NAMES, row.tolist(), strict=True))
        words, lines = K.word_list(t), [x for x in t.split("\n") if x]
        assert n["n_chars"] == len(t) and n["n_words"] == len(words) and n["n_types"] == len(set(words))
        assert n["n_repeats"] == sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert n["n_lines"] == len(lines) and n["n_repeated_lines"] == len(lines) - len(set(lines))
        assert n["n_symbols"] == sum(c in features.SYMBOLS for c in t)
