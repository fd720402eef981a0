"""BPE through the lexicon against a plain implementation of the same vocabulary, and exact round trips."""

import base64
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import bpe


from .support import TEXTS, awkward, empty

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def plain():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(bpe.VOCABULARY)


def ids_of(encoder, texts):
    return [ids[a:b].tolist() for _, ids, off in encoder.encode(texts) for a, b in zip(off[:-1], off[1:], strict=True)]


def test_same_as_plain(plain, vocabulary):
    encoder = bpe.Encoder.compile(vocabulary, [b" the", b"the", b" quick", b" then", b"a", b" fox"])
    texts = [t or "" for t in TEXTS] + ["it's we'll they've 'tis I'm'x don't'd", "  two  spaces ", " a \n b", "a'", "'", "'s", " x　y", "Ⅷ½²", "\r\n\r\n x"]
    got = ids_of(encoder, texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids == plain.encode_ordinary(t), t[:40]
        assert encoder.decode(np.array(ids, np.int64)).decode() == t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs", "Cn"]), max_size=30), max_size=5))
def test_any_text(plain, vocabulary, texts):
    assert ids_of(bpe.Encoder.compile(vocabulary, [b" a", b"ab"]), texts) == [plain.encode_ordinary(t) for t in texts]


def test_documents(plain, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bpe.op6_bpe(spark, sf).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == plain.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_automaton(vocabulary):
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 7))).encode() for _ in range(400)})
    encoder = bpe.Encoder.compile(vocabulary, words)
    tries = words + ["".join(rng.choices("abcde", k=rng.randint(1, 8))).encode() for _ in range(600)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in tries])])
    found = encoder.find(np.frombuffer(b"".join(tries), np.uint8), off[:-1], off[1:])
    place = {w: k for k, w in enumerate(words)}
    assert found.tolist() == [place.get(t, -1) for t in tries]
    # minimal: as many states as there are distinct sets of endings
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(encoder.base) == len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_file_round_trip(vocabulary, tmp_path):
    encoder = bpe.Encoder.compile(vocabulary, [b"hello", b" world"])
    (tmp_path / "x").write_bytes(encoder.tobytes())
    again = bpe.Encoder.open(str(tmp_path / "x"))
    assert ids_of(again, ["hello world!"]) == ids_of(encoder, ["hello world!"])


def test_forgetting_changes_nothing(vocabulary, plain, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 20)
    encoder = bpe.Encoder.compile(vocabulary, [])
    texts = [f"alpha{k} beta{k} gamma{k}" for k in range(60)]
    assert [ids_of(encoder, [t])[0] for t in texts] == [plain.encode_ordinary(t) for t in texts]


def test_awkward(spark):
    docs = awkward(spark)
    got = bpe.encode(docs, bpe.compiled(docs))
    assert got.count() == docs.count() and got.where("NOT round_trip").count() == 0
    assert dict(got.dtypes)["token_ids"] == "array<int>" and dict(got.dtypes)["n_tokens"] == "int" and "Token_IDs" not in got.columns
    assert {r.n_tokens for r in got.where("text IS NULL OR text = ''").collect()} == {0}
    back = bpe.decode(got, bpe.compiled(docs))
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert bpe.encode(empty(spark), bpe.compiled(empty(spark))).count() == 0


def test_frequent_counts_everything(spark):
    df = spark.createDataFrame([(1, "b b b b a a c"), (2, None), (3, " a b")], "doc_id long, text string")
    assert bpe.frequent(df) == [b" b", b" a"]
    assert bpe.frequent(df, most=1) == [b" b"]
