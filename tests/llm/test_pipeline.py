"""The pipeline: each stage on what its predecessor kept, against brute force where SQL cannot express it."""

import pytest

import corpus_pipeline
from quirefold.llm import catalog, langid

from . import test_nearjoin, test_packing
from .support import awkward, empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs
        f(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((before, docs))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language identification", "near duplicates", "packing"]
    for before, after in stages[:-1]:
        assert before.columns == after.columns == COLUMNS
        assert after.exceptAll(before).count() == 0
    for k in (0, 2):
        assert stages[k][1].count() < stages[k][0].count()


def test_clean_documents_stay(stages, spark, sf):
    before, after = stages[0]
    clean = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").join(before, "doc_id", "left_semi")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.1 * clean.count()


def test_language_stage_is_the_rule(stages):
    before, after = stages[1]
    want = {r.doc_id for r in langid.identify(before, langid.train(before)).where("accepted").collect()}
    assert {r.doc_id for r in after.collect()} == want


def test_no_near_duplicates_are_left(stages):
    before, after = stages[2]
    assert test_nearjoin.brute([(r.doc_id, r.text) for r in after.collect()]) == {}
    gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()}
    found = test_nearjoin.brute([(r.doc_id, r.text) for r in before.collect()])
    assert gone <= {b for _, b in found} | {a for a, _ in found}


def test_windows_hold_all_that_was_kept(stages):
    before, after = stages[3]
    test_packing.covered(after.collect(), before)


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == stages[3][1].columns and got.agg({"n_tokens": "sum"}).first()[0] == stages[3][1].agg({"n_tokens": "sum"}).first()[0]


def test_stages_take_awkward_tables(spark, sf):
    for docs in (awkward(spark, extra=False), empty(spark).select(*COLUMNS)):
        for _, f in corpus_pipeline.STAGES:
            f(spark, docs, sf).count()


def test_stages_keep_columns_whose_names_clash(spark, sf):
    clash = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, quality_score int, __kept string, __score string, distance string, Margin string, accepted int, predicted_lang string, __gone string, id string, h1 string"
    docs = spark.createDataFrame([(i, f"the cat and the dog sat on mat number {i} and the bird sang", "en", "s", 9, *[str(i)], i, *["x"] * 4, i, *["y"] * 4) for i in range(30)], clash)
    for _, f in corpus_pipeline.STAGES[:-1]:
        after = f(spark, docs, sf)
        assert after.columns == docs.columns and after.exceptAll(docs).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_catalogue(sf):
    assert sorted(int(q[2:].split("_")[0]) for q in catalog.QUERIES) == list(range(1, 11))
    assert set(catalog.SQL) <= set(catalog.QUERIES)
