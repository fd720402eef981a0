"""Class-based language model against counts and probabilities worked out word by word."""

import math
from collections import Counter

import numpy as np
import pytest

from quirefold.llm import classlm
from quirefold.llm import textkernel as K

from .support import awkward, empty

SENTENCES = ["the cat sat on the mat", "the dog sat on the rug", "a cat ran", "a dog ran to the mat", "the bird sang", "a bird sat on the mat and the dog ran"] * 3


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(list(enumerate(SENTENCES)), "doc_id long, text string")


def test_counts(small):
    got = {r.hash: r.n for r in classlm.word_counts(small.select("text")).collect()}
    want = Counter(w for s in SENTENCES for w in s.split())
    assert got == {np.uint64(K.hash_word(w)).astype(np.int64): n for w, n in want.items()}


def test_bigrams(small):
    want = Counter()
    words = sorted({w for s in SENTENCES for w in s.split()}, key=lambda w: int(np.uint64(K.hash_word(w)).astype(np.int64)))[:8]
    known = np.array([np.uint64(K.hash_word(w)).astype(np.int64) for w in words])
    ids = {w: k for k, w in enumerate(words)}
    for s in SENTENCES:
        now = [9] + [ids.get(w, 8) for w in s.split()]
        want.update(zip(now, now[1:], strict=False))
    right, left = Counter(), Counter()
    for r in classlm.bigrams(small.select("text"), known).collect():
        for side, other, n in ((right, r.right, r.right_n), (left, r.left, r.left_n)):
            for o, k in zip(np.frombuffer(other, np.int32).tolist(), np.frombuffer(n, np.int64).tolist(), strict=True):
                side[(r.w, o) if side is right else (o, r.w)] += k
    assert right == want and left == want


def test_gains_are_exact():
    rng = np.random.default_rng(6)
    words, classes = 14, 4
    c = rng.integers(0, 9, (words + 2, words + 2)) * (rng.random((words + 2, words + 2)) < 0.6)
    label = np.append(rng.integers(0, classes, words), [classes, classes + 1])

    def matrix(lab):
        m = np.zeros((classes + 2, classes + 2))
        np.add.at(m, (lab[:, None].repeat(len(lab), 1), lab[None, :].repeat(len(lab), 0)), c)
        return m

    m = matrix(label)
    for w in range(words):
        right, left = np.bincount(label, c[w], classes + 2), np.bincount(label, c[:, w], classes + 2)
        got = classlm.gains(m, int(label[w]), right, left, float(c[w, w]), classes)
        for k in range(classes):
            other = label.copy()
            other[w] = k
            assert math.isclose(got[k], classlm.likelihood(matrix(other)) - classlm.likelihood(m), abs_tol=1e-6)


def test_clustering_raises_the_likelihood(small):
    counts = Counter(w for s in SENTENCES for w in s.split())
    top = sorted((int(np.uint64(K.hash_word(w)).astype(np.int64)), n) for w, n in counts.items())
    known, n = np.array([t[0] for t in top]), np.array([t[1] for t in top])
    pairs = classlm.cut(classlm.bigrams(small.select("text"), known))
    _, first = classlm.cluster(pairs, n, 4, 0)
    _, last = classlm.cluster(pairs, n, 4, 12)
    assert classlm.likelihood(last) > classlm.likelihood(first)
    assert last.sum() == sum(len(s.split()) for s in SENTENCES)


def test_scores_word_by_word(small):
    model = classlm.train(small, vocabulary=6, classes=3)
    ids = {int(h): k for k, h in enumerate(model.known)}
    for r in classlm.score(small, model).collect():
        before, total = len(model.known) + 1, 0.0
        for w in r.text.split():
            k = ids.get(int(np.uint64(K.hash_word(w)).astype(np.int64)), len(model.known))
            total += model.transition[model.classes[before], model.classes[k]] + model.emission[k]
            before = k
        assert r.n_words == len(r.text.split()) and math.isclose(r.log_prob, total) and math.isclose(r.perplexity, math.exp(-total / r.n_words))


def test_probabilities_sum_to_one(small):
    model = classlm.train(small, vocabulary=6, classes=3)
    assert np.allclose(np.exp(model.transition).sum(axis=1), 1)
    types = len({w for s in SENTENCES for w in s.split()})
    rare = types - 6
    for k in range(3):
        mass = np.exp(model.emission[:6])[model.classes[:6] == k].sum()
        assert mass == 0 or np.isclose(mass, 1)
    assert np.isclose(np.exp(model.emission[6]) * (rare + 1), 1)


def test_familiar_text_is_likelier(small, spark):
    model = classlm.train(small)
    odd = spark.createDataFrame([(1, "the dog sat on the mat"), (2, "mat the on sat dog the"), (3, "zyx qwv utr")], "doc_id long, text string")
    p = {r.doc_id: r.perplexity for r in classlm.score(odd, model).collect()}
    assert p[1] < p[2] < p[3]


def test_awkward(spark):
    docs = awkward(spark)
    got = classlm.score(docs, classlm.train(docs, classes=4))
    assert got.count() == docs.count() and dict(got.dtypes)["perplexity"] == "double" and dict(got.dtypes)["n_words"] == "bigint"
    none = got.where("text IS NULL OR trim(text) = ''").collect()
    assert none and all(r.n_words == 0 and r.perplexity is None and r.log_prob == 0 for r in none)
    assert got.where("doc_id = 4").select("perplexity").distinct().count() == 1
    assert got.where("n_words > 0 AND (perplexity IS NULL OR isnan(perplexity))").count() == 0
    assert classlm.score(empty(spark), classlm.train(empty(spark))).count() == 0
    assert classlm.score(docs, classlm.train(empty(spark))).count() == docs.count()


def test_every_repeated_word_has_its_own_class_and_emission(spark):
    texts = [f"w{k} w{k * 7 % 900} w{k} the" for k in range(900)] + [f"once{k}" for k in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = classlm.train(docs, classes=4, core=20)
    n = Counter(w for t in texts for w in t.split())
    want = {int(np.uint64(K.hash_word(w)).astype(np.int64)): k for w, k in n.items() if k > 1}
    assert dict.fromkeys(model.known.tolist()) == dict.fromkeys(sorted(want)) and set(model.classes[: len(want)]) <= set(range(4))
    mass = np.bincount(model.classes[: len(want)], [want[h] for h in model.known.tolist()], 4)
    assert np.allclose(np.exp(model.emission[:-1]), [want[h] / mass[c] for h, c in zip(model.known.tolist(), model.classes.tolist(), strict=False)])
    assert np.isclose(np.exp(model.emission[-1]) * (len(n) - len(want) + 1), 1)
    ids = {h: k for k, h in enumerate(model.known.tolist())}
    for r in classlm.score(docs, model).collect()[::60]:
        prior, total = len(ids) + 1, 0.0
        for w in r.text.split():
            k = ids.get(int(np.uint64(K.hash_word(w)).astype(np.int64)), len(ids))
            total += model.transition[model.classes[prior], model.classes[k]] + model.emission[k]
            prior = k
        assert math.isclose(r.log_prob, total)


def test_best_class_is_the_likeliest():
    rng = np.random.default_rng(3)
    movable, tile = 4, np.tile(np.arange(6), 2)
    for own in (4, 1):
        for _ in range(20):
            right, left = rng.integers(0, 30, 6), rng.integers(0, 30, 6)
            right[own] = left[own] = right[5] = 0  # it is not beside its own class, and nothing leads to a beginning
            left[0] += max(0, right.sum() - left.sum())
            right[0] += max(0, left.sum() - right.sum())
            rest = rng.integers(200, 4000, (6, 6))

            def at(k, rest=rest, right=right, left=left):
                m = rest.copy()
                m[k] += right
                m[:, k] += left
                return m

            _, c = classlm.best_classes(np.zeros(12, np.int64), np.repeat([0, 1], 6), tile, np.concatenate([right, left]), np.full(12, own), at(own), movable)
            value = [classlm.likelihood(at(k)) for k in range(movable)]
            assert value[c[0]] >= max(value) - 0.05 * (max(value) - min(value))


def test_query_word_by_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = classlm.train(docs)
    ids = {h: k for k, h in enumerate(model.known.tolist())}
    got = {r.doc_id: r for r in classlm.op8_class_lm(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words, prior, total = K.word_list(r.text), len(ids) + 1, 0.0
        for w in words:
            k = ids.get(int(np.uint64(K.hash_word(w)).astype(np.int64)), len(ids))
            total += model.transition[model.classes[prior], model.classes[k]] + model.emission[k]
            prior = k
        g = got[r.doc_id]
        assert g.n_words == len(words) and math.isclose(g.log_prob, total, abs_tol=1e-9)
        assert g.perplexity is None if not words else math.isclose(g.perplexity, math.exp(-total / len(words)))
