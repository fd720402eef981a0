"""Bounded-space packing of documents in windows of tokens.

Each partition keeps at most ``OPEN`` windows open.  A document goes, whole, into the open window that it fills best:
the one with the least room in which it fits.  Where none fits, a new window is opened; were that one too many, the
fullest is emitted first.  A full window is emitted at once.  A document longer than a window is cut into whole windows
and a rest.  What is open at a partition's end is merged: the leftovers of ``TOGETHER`` partitions are packed in the
same manner, as if each were a document.

A window holds its token ids, packed in the fewest bits as ``tokenbits`` does, and says which part of which document
stands where in it: segment i is ``lengths[i]`` tokens of ``doc_ids[i]`` from its token ``starts[i]`` on, and segments
follow each other in the window.  The state is the open windows' tokens, ``OPEN`` x ``WINDOW`` ids; the one shuffle is
that of the leftovers.

Which documents share a window depends on how the input is split in partitions and on the order of rows in each; every
token is in exactly one window whatever these are.

Defined results: null and empty texts, with no tokens, are in no window; a null id stays null; repeated rows are packed
again; windows with equal room are filled in order of their opening; an empty table gives no windows; only the id and
text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, tokenbits
from . import textkernel as K
from .store import cut

WINDOW, OPEN, TOGETHER = 2048, 64, 64
#: Windows sent on at a time.
AT_ONCE = 256
Segment = tuple  # document, first token, number of tokens, and the ids where they are known
_SCHEMA = "part long, seq long, leftover boolean, n_tokens int, doc_ids array<long>, starts array<int>, lengths array<int>, tokens binary"


class Packer:
    """The open windows of one partition."""

    def __init__(self, window: int = WINDOW, most: int = OPEN) -> None:
        self.window, self.most, self.made = window, most, 0
        self.rooms: list[tuple[int, int]] = []  # (room left, order of opening), ascending
        self.held: dict[int, list[Segment]] = {}

    def put(self, size: int, segments: list[Segment]) -> Iterator[list[Segment]]:
        """Place an item of 1 .. window tokens; gives the windows that this completes."""
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, key = self.rooms.pop(at)
        else:
            if len(self.rooms) == self.most:
                yield self.held.pop(self.rooms.pop(0)[1])
            room, key = self.window, self.made
            self.made += 1
            self.held[key] = []
        self.held[key].extend(segments)
        if room == size:
            yield self.held.pop(key)
        else:
            insort(self.rooms, (room - size, key))

    def rest(self) -> list[list[Segment]]:
        """The windows still open, the fullest first."""
        return [self.held[k] for _, k in self.rooms]


def cut_up(doc: int | None, tokens: int, window: int) -> Iterator[Segment]:
    """A document's whole windows and its rest."""
    for begin in range(0, tokens, window):
        yield doc, begin, min(window, tokens - begin)


def pack_lengths(lengths: Iterable[tuple[int | None, int]], window: int = WINDOW, most: int = OPEN) -> tuple[list[list[Segment]], list[list[Segment]]]:
    """Emitted and open windows for documents' lengths in order."""
    p, out = Packer(window, most), []
    for doc, tokens in lengths:
        for s in cut_up(doc, tokens, window):
            out.extend(p.put(s[2], [s]))
    return out, p.rest()


def _batch(part: int, first: int, windows: list[list[Segment]], leftover: bool, bits: int) -> pa.RecordBatch:
    n = len(windows)
    cols = [
        pa.array([part] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([leftover] * n, pa.bool_()), pa.array([sum(s[2] for s in w) for w in windows], pa.int32()),
        *[pa.array([[s[i] for s in w] for w in windows], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))],
        pa.array([tokenbits.pack(np.concatenate([s[3] for s in w]), bits) for w in windows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "leftover", "n_tokens", "doc_ids", "starts", "lengths", "tokens"])


def window_ids(row: dict, bits: int) -> np.ndarray:
    """The token ids of a window."""
    return tokenbits.unpack(row["tokens"], bits, row["n_tokens"])


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, most: int = OPEN, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """Windows: (window_id, n_tokens, n_docs, doc_ids, starts, lengths, bits, tokens), the three arrays with an entry a segment."""
    name, size = tokenbits.vocabulary_encoder(df.sparkSession, vocabulary)
    bits = tokenbits.bits_for(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, seq = TaskContext.get().partitionId(), Packer(window, most), 0
        done: list[list[Segment]] = []
        for b in K.slices(batches):
            names = b.column(0).to_pylist()
            for rows, ids, off in bpe.opened(name).encode(K.strings(b.column(1))):
                for k, i in enumerate(range(rows.start, rows.stop)):
                    for doc, begin, n in cut_up(names[i], int(off[k + 1] - off[k]), window):
                        # a copy: a view would keep all ids of its chunk
                        own = ids[off[k] + begin : off[k] + begin + n].astype(np.int32)
                        done.extend(packer.put(n, [(doc, begin, n, own)]))
                    if len(done) >= AT_ONCE:
                        yield _batch(part, seq, done, False, bits)
                        seq, done = seq + len(done), []
        yield _batch(part, seq, done, False, bits)
        yield _batch(part, seq + len(done), packer.rest(), True, bits)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("seq", "ascending")])
        packer, done = Packer(window, most), []
        for b in table.to_batches(max_chunksize=AT_ONCE):
            for r in b.select(["n_tokens", "doc_ids", "starts", "lengths", "tokens"]).to_pylist():
                ids = np.split(window_ids(r, bits).astype(np.int32), np.cumsum(r["lengths"])[:-1])
                done.extend(packer.put(r["n_tokens"], list(zip(r["doc_ids"], r["starts"], r["lengths"], ids, strict=True))))
        return pa.Table.from_batches([_batch(key[0].as_py() | 1 << 30, 0, done + packer.rest(), False, bits)])

    source = df.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`").cast("string"))
    # written once, as both halves below read it
    made = cut(source.mapInArrow(run, _SCHEMA))
    # partition numbers, not data, decide what is merged together
    merged = made.where("leftover").groupBy((F.col("part") / TOGETHER).cast("long").alias("group")).applyInArrow(merge, _SCHEMA)
    both = made.where("NOT leftover").unionByName(merged)
    return both.select((F.shiftleft("part", 32) + F.col("seq")).alias("window_id"), "n_tokens", F.size("doc_ids").alias("n_docs"), "doc_ids", "starts", "lengths", F.lit(bits).alias("bits"), "tokens")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed in windows of 2048 tokens, with their ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's documents packed in windows."""
    return pack(docs)
