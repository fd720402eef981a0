"""Token ids as packed bits: each id takes the fewest bits that hold the vocabulary.

A shard holds up to ``SHARD_TOKENS`` ids of consecutive documents (one longer document is a shard by itself), in blocks
of ``BLOCK_TOKENS``.  Blocks begin at whole bytes, which ``block_offsets`` lists; ``doc_offsets`` tells where each
document's ids begin and where the last one's end.  Bit i of an id's place is its bit of value 2^i, low bits first, so a
block unpacks by array operations, and any range of ids is read from the blocks that hold it alone.

Defined results: null and empty texts are documents of no ids; a null id stays null in ``doc_ids``; repeated rows are
written again; an empty table gives no shards; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from . import textkernel as K
from .store import publish

SHARD_TOKENS, BLOCK_TOKENS = 1 << 20, 4096
SCHEMA = "shard long, n_docs int, n_tokens long, bits int, block_tokens int, doc_ids array<long>, doc_offsets array<long>, block_offsets array<long>, payload binary"


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids end to end, ``bits`` each, low bits first; the last byte is filled up with zeros."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >> bits):
        raise ValueError(f"an id does not fit in {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # a multiple of 8 ids, so pieces join at whole bytes
        part = np.ascontiguousarray(ids[i : i + (1 << 16)].astype("<u4"))
        out.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little"), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes | np.ndarray, bits: int, count: int, skip: int = 0) -> np.ndarray:
    """``count`` ids of packed bytes after the first ``skip``."""
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return np.frombuffer(raw.tobytes(), f"<u{bits // 8}")[skip : skip + count].astype(np.int64)
    begin = skip * bits
    flat = np.unpackbits(raw[begin // 8 : -(-(begin + count * bits) // 8)], bitorder="little")[begin % 8 :][: count * bits].reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def pack_blocks(ids: np.ndarray, bits: int, block: int = BLOCK_TOKENS) -> tuple[bytes, np.ndarray]:
    """Packed blocks end to end, and where each begins; the end comes last."""
    if block * bits % 8 == 0:  # whole blocks fill whole bytes, so they pack in one go
        data = pack(ids, bits)
        starts = np.arange(0, len(ids), block) * bits // 8
        return data, np.append(starts, len(data)).astype(np.int64)
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    return b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def read(payload: bytes, bits: int, block_offsets: np.ndarray, begin: int, end: int, block: int = BLOCK_TOKENS) -> np.ndarray:
    """Ids begin .. end of a shard, from the blocks that hold them."""
    out, at = [np.zeros(0, np.int64)], begin
    while at < end:
        k = at // block
        stop = min(end, (k + 1) * block)
        out.append(unpack(payload[int(block_offsets[k]) : int(block_offsets[k + 1])], bits, stop - at, at - k * block))
        at = stop
    return np.concatenate(out)


def read_document(shard: dict, index: int) -> np.ndarray:
    """Ids of the document at an index of a shard's row."""
    begin, end = shard["doc_offsets"][index], shard["doc_offsets"][index + 1]
    return read(shard["payload"], shard["bits"], shard["block_offsets"], begin, end, shard["block_tokens"])


def vocabulary_encoder(spark: SparkSession, vocabulary: str) -> tuple[str, int]:
    """Name of a published encoder whose lexicon is the vocabulary itself, and the number of ids."""
    v = bpe.read_vocabulary(vocabulary)
    raw = v.data.tobytes()
    words = [raw[a:b] for a, b in zip(v.off[:-1].tolist(), v.off[1:].tolist(), strict=True)]
    return publish(spark, bpe.Encoder.compile(v, words).tobytes(), ".bpe"), len(words)


def shards(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Shards of packed ids, in one pass without a shuffle; ``shard`` counts within a partition, whose number is its high bits."""
    name, size = vocabulary_encoder(df.sparkSession, vocabulary)
    bits = bits_for(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0

        def give() -> pa.RecordBatch:
            ids = np.concatenate([np.zeros(0, np.int32), *held])
            payload, starts = pack_blocks(ids, bits)
            off = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            row = {"shard": part << 32 | made, "n_docs": len(docs), "n_tokens": len(ids), "bits": bits, "block_tokens": BLOCK_TOKENS, "doc_ids": docs, "doc_offsets": off, "block_offsets": starts, "payload": payload}
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for b in K.slices(batches):
            encoder, names, texts = bpe.opened(name), b.column(0).to_pylist(), K.strings(b.column(1))
            for rows, ids, off in encoder.encode(texts):
                for k, i in enumerate(range(rows.start, rows.stop)):
                    one = ids[off[k] : off[k + 1]]
                    if docs and total + len(one) > SHARD_TOKENS:
                        yield give()
                        made, docs, held, total = made + 1, [], [], 0
                    docs.append(names[i])
                    held.append(one)
                    total += len(one)
        if docs:
            yield give()

    return df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, SCHEMA)


def op4_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed shards of all documents."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
