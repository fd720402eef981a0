"""Packed bits: exact round trips, random access, awkward rows."""

import numpy as np
import pytest

from quirefold.llm import bpe, tokenbits

from .support import awkward, empty


@pytest.mark.parametrize("bits", range(1, 33))
def test_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 4096, 5000):
        ids = rng.integers(0, 1 << bits, n)
        ids[:1] = (1 << bits) - 1
        data = tokenbits.pack(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert (tokenbits.unpack(data, bits, n) == ids).all()
        value = sum(int(x) << (k * bits) for k, x in enumerate(ids[:64]))
        assert int.from_bytes(data, "little") & ((1 << (64 * bits)) - 1 if n >= 64 else -1) == value
        for block in (1, 3, 8, 64):
            payload, off = tokenbits.pack_blocks(ids, bits, block)
            for a, b in ((0, n), (n // 3, n // 2), (n, n), (max(0, n - 1), n)):
                assert (tokenbits.read(payload, bits, off, a, b, block) == ids[a:b]).all()


def test_bits_for():
    assert [tokenbits.bits_for(v) for v in (1, 2, 3, 256, 257, 50256, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_does_not_fit():
    with pytest.raises(ValueError, match="does not fit"):
        tokenbits.pack(np.array([8]), 3)


def encoded(df):
    got = bpe.encode(df, bpe.compiled(df))
    return sorted(((r.doc_id, tuple(r.token_ids)) for r in got.select("doc_id", "token_ids").collect()), key=str)


def unpacked(rows):
    return sorted(((i, tuple(tokenbits.read_document(r.asDict(), k).tolist())) for r in rows for k, i in enumerate(r.doc_ids)), key=str)


def test_documents(spark, sf, monkeypatch):
    rows = tokenbits.op4_token_bits(spark, sf).collect()
    assert unpacked(rows) == encoded(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    assert all(r.n_tokens == r.doc_offsets[-1] and r.n_docs == len(r.doc_ids) and len(r.payload) == r.block_offsets[-1] for r in rows)
    assert len({r.shard for r in rows}) == len(rows)


def test_shards_fill_up(spark):
    docs = spark.createDataFrame([(i, "a b c d e " * (40_000 if i == 2 else 50_000)) for i in range(8)], "doc_id long, text string").coalesce(1)
    rows = tokenbits.shards(docs).collect()
    assert len(rows) > 1 and unpacked(rows) == encoded(docs)
    assert all(r.n_tokens <= tokenbits.SHARD_TOKENS or r.n_docs == 1 for r in rows)


def test_awkward(spark):
    docs = awkward(spark)
    assert unpacked(tokenbits.shards(docs).collect()) == encoded(docs)
    assert tokenbits.shards(empty(spark)).count() == 0
