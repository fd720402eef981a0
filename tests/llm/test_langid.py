"""Language identification against profiles counted one n-gram at a time; the SQL; held-out accuracy."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quirefold.llm import langid
from quirefold.llm import textkernel as K

from .support import TEXTS, awkward, empty, same


def slow(text):
    out = Counter()
    now = ""
    for c in (text or "") + " ":
        if K.char_class()[ord(c)] in (K.LETTER, K.MARK):
            now += chr(K.lower_table()[ord(c)])
        elif now:
            s = f" {now} "
            for n in (1, 2, 3):
                out.update(s[i : i + n] for i in range(len(s) - n + 1) if s[i : i + n] != " ")
            now = ""
    return out


def key(g):
    a = [ord(c) for c in g] + [0, 0]
    return (a[0] << 42) | (a[1] << 21) | a[2]


def test_grams():
    for t, g in zip(TEXTS, langid.text_grams([t or "" for t in TEXTS]), strict=True):
        # a space between two words is one character of the padded text but ends one word and begins the next
        assert Counter(g.tolist()) == Counter({key(k): n for k, n in slow(t).items()}), (t or "")[:30]


def test_profile_order():
    p = langid.profile(np.array([5, 3, 3, 9, 9, 1]), 3)
    assert p.tolist() == [3, 9, 1]


def test_distance():
    p = langid.Profiles(["x", "y"], np.array([1, 2, 3]), np.array([[0, 1, -1], [2, -1, 0]]), 4)
    assert langid.distances(p, np.array([2, 3, 7])).tolist() == [1 + 4 + 4, 4 + 1 + 4]


def test_query(spark, sf):
    same(langid.op10_language_id(spark, sf), sf, langid.sql())


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    even = F.xxhash64("doc_id") % 2 == 0
    rows = langid.identify(docs.where(~even), langid.train(docs.where(even))).where("accepted AND n_chars > 40").select("lang", "predicted_lang").collect()
    assert np.mean([r.lang == r.predicted_lang for r in rows]) > 0.95


def test_other_languages_are_rejected(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    other = [(-1, "Pääministeri kävi eilen työmatkalla pohjoisessa ja tapasi siellä yrittäjiä", None), (-2, "Быстрая лиса прыгает через ленивую собаку", None), (-3, "素早い狐が怠け者の犬を飛び越える", None), (-4, "zzzq xkcd qqxz wvwv kkqq", None)]
    both = docs.unionByName(spark.createDataFrame(other, docs.schema))
    left = langid.stage(spark, both, sf)
    assert left.where("doc_id < 0").count() == 0 and left.count() > 0.99 * docs.count()


def test_awkward(spark):
    docs = awkward(spark)
    got = langid.identify(docs, langid.train(docs))
    assert got.count() == docs.count() and dict(got.dtypes)["accepted"] == "boolean" and "Distance" not in got.columns
    none = got.where("text IS NULL OR text = '' OR text = '12345 67890'").collect()
    assert len(none) == 4 and all(r.predicted_lang is None and r.distance == 1 and not r.accepted for r in none)
    assert got.where("doc_id = 4").select("distance").distinct().count() == 1
    assert langid.identify(empty(spark), langid.train(empty(spark))).count() == 0
    assert langid.identify(docs, langid.train(empty(spark))).where("accepted").count() == 0
    assert langid.stage(spark, docs, "").columns == docs.columns
