"""N-gram Jaccard join against all pairs of sets."""

import random

import numpy as np
import pytest

from quirefold.llm import nearjoin
from quirefold.llm import textkernel as K

from .support import awkward, empty


def brute(rows, n=3, threshold=0.5):
    sets = {}
    for i, t in rows:
        w = K.word_list(t)
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        if i is not None and s:
            sets.setdefault(i, []).append(s)
    ids, out = sorted(sets), {}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            j = max(len(p & q) / len(p | q) for p in sets[a] for q in sets[b])
            if j >= threshold:
                out[a, b] = j
    return out


def classes(rows):
    """Class and number of links of every document, from the sets of all rows."""
    sets = {}
    for i, t in rows:
        w = K.word_list(t)
        s = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset({tuple(w)} if w else ())
        if i is not None:
            sets.setdefault(i, set()).add(s)
    records = [(i, s) for i in sets for s in sets[i]]
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, p) in enumerate(records):
        for j, q in records[:x]:
            if p and q and len(p & q) / len(p | q) >= 0.5:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (top(i), links[i]) for i in sets}


def found(df):
    got = {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}
    assert len(got) == df.count()
    return got


def pairs(df):
    """All pairs of documents: those of different sets and, by membership, of equal ones."""
    group = {}
    for r in nearjoin.copies(df).collect():
        group.setdefault(r.least, []).append(r.doc_id)
    out = {(a, b): 1.0 for g in group.values() for a in g for b in g if a < b}
    for r in nearjoin.pairs(df).collect():
        out |= {(min(a, b), max(a, b)): r.jaccard for a in group[r.doc_id_a] for b in group[r.doc_id_b]}
    return out


def copies(seed=5, groups=25):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    out = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([4, 12, 60, 200]))
        for _ in range(rng.choice([1, 2, 3, 9])):
            t = [w if rng.random() > 0.03 else rng.choice(words) for w in base]
            out.append((len(out), " ".join(t)))
    return out


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = classes(rows), found(nearjoin.op2_ngram_jaccard_join(spark, sf))
    assert set(got) == set(want) and all(got[i][1] <= want[i][1] for i in want)
    assert sum(n for _, n in got.values()) >= 0.97 * sum(n for _, n in want.values()) > 0
    assert np.mean([got[i][0] == want[i][0] for i in want]) > 0.99


def test_pairs_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, got = brute([(r.doc_id, r.text) for r in docs.collect()]), pairs(docs)
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.97 * len(want) and want


def test_planted_near_copies(spark):
    rows = copies()
    want = brute(rows)
    got = pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(got) >= 0.97 * len(want)


def test_weak_pairs_are_found_beside_a_hot_group(spark):
    rng = random.Random(3)
    base, words = [f"w{k}" for k in range(100)], [f"v{k}" for k in range(30000)]
    rows = [(k, " ".join(base[: 95 + k % 5] + [f"own{k}"])) for k in range(400)]
    for _ in range(150):  # pairs of similarity 0.5 to 0.6
        t = rng.sample(words, 80)
        rows += [(len(rows), " ".join(t[:62])), (len(rows) + 1, " ".join(t[18:80]))]
    want = {k: v for k, v in brute(rows).items() if k[0] >= 400}
    got = pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(want) == 150 and max(want.values()) < 0.65
    assert len(set(want) & set(got)) >= 0.94 * len(want)


def test_units_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(nearjoin, "UNIT", 8)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[: 118 - i % 5] + [f"own{i}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(pairs(docs)) == set(brute(rows)) and found(nearjoin.classes(docs)) == classes(rows)


def test_large_group_of_copies(spark):
    rows = [(i, "a passage that many many pages hold word for word and nothing else") for i in range(3000)] + [(5000, "something else entirely is written here")]
    got = found(nearjoin.classes(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {**{i: (0, 2999) for i in range(3000)}, 5000: (5000, 0)}


def test_copies_and_ids_of_several_texts(spark):
    base = [f"w{k}" for k in range(60)]
    near = base[:-2] + ["other", "words"]
    texts = [" ".join(base)] * 30 + [" ".join(near)] * 20 + ["a text that stands alone here"]
    rows = [(i, t) for i, (_, t) in enumerate(sorted(enumerate(texts), key=lambda x: x[0] * 7 % len(texts)))]
    rows += [(200, " ".join(base)), (200, "one more text of quite other words"), (201, "one more text of quite other words"), (202, "one more text of quite other words again"), (0, rows[0][1]), (0, rows[0][1]), (201, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(nearjoin.classes(docs)) == classes(rows)


def test_first_hash_words_that_collide(spark, monkeypatch):
    old = nearjoin.set_hash
    monkeypatch.setattr(nearjoin, "set_hash", lambda s: (7, old(s)[1]))
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base[: 50 + i])) for i in range(8)] + [(20, "a text that stands alone here")]
    assert found(nearjoin.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == classes(rows)


def test_low_thresholds(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d x y z w")], "doc_id long, text string")
    assert found(nearjoin.classes(docs, threshold=0.2)) == {1: (1, 1), 2: (1, 1)}
    with pytest.raises(ValueError):
        nearjoin.classes(docs, threshold=0.05)


def test_awkward(spark):
    got = found(nearjoin.classes(awkward(spark)))
    assert got == {i: (i, 0) for i in range(16)} | {4: (4, 1), 5: (4, 1)}
    assert nearjoin.classes(empty(spark)).count() == 0 and nearjoin.pairs(empty(spark)).count() == 0
    for extra in (False, True):
        docs = awkward(spark, extra)
        left = nearjoin.stage(spark, docs, "")
        assert left.columns == docs.columns
        assert left.count() == docs.count() - 1 and left.where("doc_id = 5").count() == 0 and left.where("doc_id IS NULL").count() == 1
    assert nearjoin.stage(spark, empty(spark), "").count() == 0


def test_one_of_each_group_stays(spark):
    rows = copies(11)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in nearjoin.stage(spark, docs, "").collect()}
    assert left == {i for i, (c, _) in found(nearjoin.classes(docs)).items() if i == c}


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    assert {r.id: r.root for r in nearjoin.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
