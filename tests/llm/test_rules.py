"""Risk-controlled rules: exact bounds, cutoffs against a plain search, the SQL, awkward rows."""

import math
import random

import numpy as np


from quirefold.llm import rules

from .support import awkward, empty, labels, same


def test_binomial():
    for n, p in ((5, 0.3), (40, 0.02), (200, 0.5)):
        for k in (0, 1, n // 2, n):
            assert math.isclose(rules.binomial_cdf(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def plain(good, bad, families, alpha, delta, n_rules):
    """The strictest-gain certified cutoff, from raw ratios."""
    best, gain = None, 0
    for j in range(rules.STEPS, -1, -1):
        c = j / rules.STEPS
        k, hit = sum(x > c for x in good), sum(x > c for x in bad)
        if not good or rules.binomial_cdf(k, len(good), alpha / n_rules) > delta / families:
            break
        if hit - k > gain:
            best, gain = c, hit - k
    return best


def synthetic(spark, n=6000, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        lang = "en" if i % 3 else None
        text = ("WORD " * 20 if rng.random() < 0.5 else "word " * 20) if bad else " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=20)) + (" X1" if rng.random() < 0.1 else "")
        rows.append((i, lang, text))
        marks.append((i, 0 if bad else 1, 0))
    return spark.createDataFrame(rows, "doc_id long, lang string, text string"), labels(spark, marks)


def test_cutoffs(spark):
    docs, marks = synthetic(spark)
    counted = rules.with_counts(docs)
    got = rules.calibrate(counted, marks)
    good, bad = {}, {}
    quality = {r.doc_id: r.quality for r in marks.collect()}
    for r in counted.select("doc_id", "lang", *[rules.ratio(x).alias(x) for x in rules.RULES]).collect():
        for x in rules.RULES:
            (good if quality[r.doc_id] else bad).setdefault((r.lang, x), []).append(r[x])
    want = {k: c for k in good if (c := plain(good[k], bad.get(k, []), 2 * len(rules.RULES), rules.ALPHA, rules.DELTA, len(rules.RULES))) is not None}
    assert got == want and got
    left = {r.doc_id for r in rules.kept(counted, got).collect()}
    for lang in (None, "en"):
        mine = [i for i in quality if quality[i] and ((i % 3 > 0) == (lang == "en"))]
        assert np.mean([i not in left for i in mine]) <= rules.ALPHA
    assert sum(i not in left for i in quality if not quality[i]) > 0.8 * sum(1 for i in quality if not quality[i])


def test_too_few_labels_switch_rules_off(spark):
    docs, marks = synthetic(spark, 300)
    counted = rules.with_counts(docs)
    assert rules.calibrate(counted, marks) == {} and rules.kept(counted, {}).count() == 300


def test_query(spark, sf, tmp_path):
    same(rules.op9_quality_rules(spark, sf), sf, rules.sql())


def test_query_with_rules_in_force(spark, tmp_path):
    import duckdb

    docs, marks = synthetic(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    marks.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = rules.op9_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    ids = {r[0] for r in con.execute(f"SELECT doc_id FROM ({rules.sql()})").fetchall()}
    assert ids == {r.doc_id for r in got.collect()} and 0 < len(ids) < 6000


def test_awkward(spark):
    docs = awkward(spark).drop("Distance")
    counted = rules.with_counts(docs)
    found = rules.calibrate(counted, labels(spark, [(4, 1, 0), (None, 1, 0), (5, None, 0), (77, 0, 1)]))
    assert rules.kept(counted, found).count() == docs.count()
    assert rules.kept(counted, {(None, "upper"): 0.0}).where("lang IS NULL AND n_upper > 0").count() == 0
    assert rules.kept(rules.with_counts(empty(spark)), rules.calibrate(rules.with_counts(empty(spark)), labels(spark))).count() == 0
    assert counted.where("doc_id = 0").select(*[rules.ratio(x).alias(x) for x in rules.RULES]).distinct().collect()[0] == (0.0,) * len(rules.RULES)
