"""Bounded-space packing against a step-by-step version; every token in exactly one place."""

import random

from quirefold.llm import bpe, packing

from .support import awkward, empty


def slow(lengths, window, most):
    """The same rules with lists alone."""
    open_, out, made = [], [], 0
    for doc, tokens in lengths:
        for begin in range(0, tokens, window):
            size = min(window, tokens - begin)
            fit = [w for w in open_ if w["room"] >= size]
            if fit:
                w = min(fit, key=lambda w: (w["room"], w["order"]))
            else:
                if len(open_) == most:
                    full = min(open_, key=lambda w: (w["room"], w["order"]))
                    open_.remove(full)
                    out.append(full["held"])
                w = {"room": window, "order": made, "held": []}
                made += 1
                open_.append(w)
            w["room"] -= size
            w["held"].append((doc, begin, size))
            if not w["room"]:
                open_.remove(w)
                out.append(w["held"])
    return out, [w["held"] for w in sorted(open_, key=lambda w: (w["room"], w["order"]))]


def test_same_as_slow():
    rng = random.Random(1)
    for most in (1, 2, 5, 64):
        lengths = [(i, rng.choice([0, 1, 5, 30, 64, 65, 200])) for i in range(400)]
        assert packing.pack_lengths(lengths, 64, most) == slow(lengths, 64, most)


def places(rows):
    out = {}
    for r in rows:
        assert r.n_tokens == sum(r.lengths) <= packing.WINDOW and r.n_docs == len(r.doc_ids) == len(r.starts) > 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            out.setdefault(d, []).append((s, n))
    return out


def covered(rows, docs):
    """Asserts that every document can be put together again from the windows."""
    tokens, whole = {}, {}
    for r in bpe.encode(docs, bpe.compiled(docs)).select("doc_id", "n_tokens", "token_ids").collect():
        tokens.setdefault(r.doc_id, []).append(r.n_tokens)
        whole.setdefault(r.doc_id, []).append(list(r.token_ids))
    got, pieces = places(rows), {}
    for r in rows:
        ids, at = packing.window_ids(r.asDict(), r.bits).tolist(), 0
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            pieces.setdefault(d, []).append((s, ids[at : at + n]))
            at += n
        assert at == len(ids)
    for d, texts in whole.items():
        want = [(b, t[b : b + packing.WINDOW]) for t in texts for b in range(0, len(t), packing.WINDOW)]
        assert sorted(pieces.get(d, [])) == sorted(want)
    for d, sizes in tokens.items():
        assert sorted(got.get(d, [])) == sorted((b, min(packing.WINDOW, n - b)) for n in sizes for b in range(0, n, packing.WINDOW))
    assert set(got) <= set(tokens)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = packing.op5_packing(spark, sf).collect()
    covered(rows, docs)
    assert len({r.window_id for r in rows}) == len(rows)


def test_query_equals_slow_on_one_partition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").coalesce(1)
    sizes = [(r.doc_id, r.n_tokens) for r in bpe.encode(docs, bpe.compiled(docs)).select("doc_id", "n_tokens").collect()]
    done, rest = slow(sizes, packing.WINDOW, packing.OPEN)
    again, last = [], packing.Packer()
    for held in rest:
        again.extend(last.put(sum(s[2] for s in held), held))
    want = done + again + last.rest()
    rows = packing.pack(docs).collect()
    assert sorted(sorted(zip(r.doc_ids, r.starts, r.lengths, strict=True)) for r in rows) == sorted(sorted(w) for w in want)


def test_leftovers_are_merged(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(64)], "doc_id long, text string").repartition(16)
    rows = packing.pack(docs).collect()
    assert len(rows) == 1 and rows[0].n_docs == 64


def test_awkward(spark):
    docs = awkward(spark)
    rows = packing.pack(docs).collect()
    covered(rows, docs)
    assert places(rows)[None]
    assert packing.pack(empty(spark)).count() == 0
