"""Quality classifier: tables added one by one, held-out accuracy, awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import gam

from .support import awkward, empty, labels


def by_hand(m, x):
    total = m.intercept
    bins = [sum(1 for e in edge if e <= v) for edge, v in zip(m.edges, x, strict=True)]
    for b, t in zip(bins, m.tables, strict=True):
        total += t[b]
    for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
        side = [bins[k] * min(gam.PAIR_BINS, len(m.tables[k])) // len(m.tables[k]) for k in (i, j)]
        total += t[side[0], side[1]]
    return total


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(gam.FEATURES)))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=600) * 0.3) > 0).astype(float)
    m = gam.fit(x, y, gam.Lexicon())
    assert m.pairs
    assert np.allclose(m.score(x[:50]), [by_hand(m, r) for r in x[:50]])
    assert ((m.score(x) > 0) == y).mean() > 0.85  # the product needs a pair's table


def test_tree_is_the_best_split():
    rng = np.random.default_rng(2)
    g, h = rng.normal(size=12), rng.random(12)
    value = lambda parts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1) for a, b in parts)
    step = gam.tree(g, h, leaves=2)
    cut = int(np.flatnonzero(np.diff(step))[0]) + 1
    assert np.isclose(value([(0, cut), (cut, 12)]), max(value([(0, k), (k, 12)]) for k in range(1, 12)))


def test_quarter_is_the_best_cross():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=(5, 4)), rng.random((5, 4))
    gain, _ = gam.quarter(g, h)
    v = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
    best = max(v(np.s_[:i, :j]) + v(np.s_[i:, :j]) + v(np.s_[:i, j:]) + v(np.s_[i:, j:]) for i in range(1, 5) for j in range(1, 4)) - v(np.s_[:, :])
    assert np.isclose(gain, best)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    even = F.xxhash64("doc_id") % 2 == 0
    m = gam.train(docs, marks.where(even))
    rows = gam.score(docs.select("doc_id", "text"), m).join(marks.where(~even), "doc_id").select("kept", "quality", "toxic").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert np.mean(clean) > 0.97
    assert np.mean([r.kept for r in rows if r.toxic == 1]) < 0.15
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_awkward(spark):
    docs = awkward(spark)
    m = gam.train(docs, labels(spark, [(4, 1, 0), (5, 0, 1), (6, None, 0), (None, 1, 0), (4, 1, 0), (99, 1, 0), (3, 0, 0), (8, 1, None)]))
    got = gam.score(docs, m)
    assert got.count() == docs.count()
    assert [c.lower() for c in got.columns].count("kept") == 1 and "kept" in got.columns and dict(got.dtypes)["quality_score"] == "double"
    twice = got.where("doc_id = 4").select("quality_score").distinct().count()
    assert twice == 1
    assert gam.score(empty(spark), m).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = awkward(spark, extra=False)
    assert gam.score(docs, gam.train(docs, labels(spark))).where("kept").count() == docs.count()
    assert gam.score(docs, gam.train(docs, labels(spark, [(4, 1, 0)]))).where("quality_score = 1").count() == docs.count()
    assert gam.score(docs, gam.train(docs, labels(spark, [(4, 0, 0)]))).where("kept").count() == 0
    assert gam.score(docs, gam.train(empty(spark), labels(spark, [(4, 1, 0)]))).count() == docs.count()


def test_query_by_hand(spark, sf):
    """Each document's score from its own text: counts, bins and table entries one at a time."""
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = gam.train(docs, marks)
    want = {}
    for r in docs.collect():
        x = gam.featurise([r.text or ""], m.lexicon)[0]
        p = 1 / (1 + np.exp(-by_hand(m, x)))
        if p >= gam.THRESHOLD:
            want[r.doc_id] = p
    got = {r.doc_id: r.quality_score for r in gam.op1_quality_classifier(spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_features_word_by_word(spark, sf):
    """What a text is described by, against plain loops over its characters, words and lines."""
    import unicodedata

    from quirefold.llm import features
    from quirefold.llm import textkernel as K

    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][::7] + ["", "A a a B\nx\nx\n", "É1 é1 #$"]
    for t, got in zip(texts, features.measure_texts(texts).tolist(), strict=True):
        words, kind = K.word_list(t), [unicodedata.category(c) for c in t]
        lines = [x for x in t.split("\n") if x]
        want = {"n_chars": len(t), "n_letters": sum(k[0] == "L" for k in kind), "n_upper": kind.count("Lu"), "n_numbers": sum(k[0] == "N" for k in kind), "n_symbols": sum(c in features.SYMBOLS for c in t), "n_words": len(words), "n_repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)), "n_types": len(set(words)), "n_lines": len(lines), "n_repeated_lines": len(lines) - len(set(lines)), "n_word_chars": sum(map(len, words))}
        assert {k: v for k, v in zip(features.NAMES, got, strict=True) if k in want} == want


def test_one_text_of_each_id_trains(spark):
    docs = spark.createDataFrame([(1, f"text number {k} of one id") for k in range(50)] + [(2, "another text")], "doc_id long, text string")
    m = gam.train(docs, labels(spark, [(1, 1, 0), (2, 0, 0)]))
    assert gam.score(docs, m).count() == 51
