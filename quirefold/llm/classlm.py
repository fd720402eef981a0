"""A class-based bigram language model: exchange clustering of words, class transitions and word emissions.

Words are counted over all texts.  Every word that occurs ``LEAST`` times or more has a class and an emission of its own;
the others, which occur once, share the class of rare words, where each has the same count; a text's beginning has a class
of its own.  The ``CORE`` most frequent words are clustered first.  Their bigram counts, again of all texts, are held as one
row a word, so each step of the clustering is a map over those rows: for every word the exact change of the class bigram
likelihood is computed for a move to each class.  Words take turns by halves; the better moves of a turn are made
together, and kept only if the likelihood rises, else the better half of them is tried, and so on.  Then, for ``ROUNDS``
rounds, all other words are moved to their best class by the counts of the classes beside them in all texts; a round after
the first is kept only if the likelihood rises.  The vocabulary grows with the texts: the driver and a file that every
worker maps hold 18 bytes a word of it.

The probability of a word w of class c after one of class b is P(c | b) P(w | c), where P(c | b) mixes the relative
frequency with the classes' own by Witten and Bell's weight, and P(w | c) is the relative frequency; the rare words'
class gives every rare type, and one more for the unseen, the same share.

Defined results: null and empty texts have 0 words, log-probability 0 and a null perplexity; repeated rows count again
and score alike; ties in frequency go in order of the word's hash; an empty table gives an empty result; columns that
clash with the new names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from . import textkernel as K
from .columns import append, most_frequent
from .store import cut, publish

LEAST, CORE, CLASSES, TURNS, ROUNDS = 2, 8192, 64, 10, 2
#: Parts of the vocabulary, each moved by one task.
SHARDS = 96
#: Counts of a word beside a class that are weighed at a time.
WEIGHED = 30_000
#: Distinct keys that a task holds before it sends them on.
HELD = 3_000_000


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Held:
    """Counts by key, gathered chunk by chunk."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)
        if self.size > 2 * HELD:
            self.parts = [self.take()]
            self.size = len(self.parts[0][0])

    def full(self) -> bool:
        return self.size > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = tally(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts])) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return out


def word_counts(texts: DataFrame) -> DataFrame:
    """(hash, n) of every word of a column of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held.take()], names=["hash", "n"])
        for b in K.slices(batches):
            for c in K.chunks(K.strings(b.column(0))):
                held.add(K.words(c).hash.view(np.int64))
            if held.full():
                yield give()
        yield give()

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def word_ids(c: K.Chunk, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number among the sorted known hashes (their number, if rare), and where documents begin."""
    w = K.words(c)
    h = w.hash.view(np.int64)
    if not len(known):
        return np.zeros(len(h), np.int64), w.off
    if len(known) > 1 << 16:  # in order, so that a large table is read in order
        h, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, at, len(known))[back], w.off
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known)), w.off


def before(ids: np.ndarray, off: np.ndarray, start: int) -> np.ndarray:
    """The id before each word; ``start`` at a document's beginning."""
    out = np.empty(len(ids), np.int64)
    out[1:] = ids[:-1]
    out[off[:-1][off[:-1] < off[1:]]] = start
    return out


def bigrams(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """(w, right, right_n, left, left_n): words after and before each word with counts, as bytes of 32 and 64 bits."""
    span = len(known) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def give() -> Iterator[pa.RecordBatch]:
            key, n = held.take()
            for side, (own, other) in enumerate(((key // span, key % span), (key % span, key // span))):
                order = np.argsort(own, kind="stable")
                own, other, count = own[order], other[order].astype(np.int32), n[order].astype(np.int32)
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                last = np.append(first[1:], len(own)) if len(own) else first
                rows = [(other[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(own[first], pa.int32()), pa.array([side] * len(first), pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["w", "side", "ids", "n"])

        for b in K.slices(batches):
            for c in K.chunks(K.strings(b.column(0))):
                ids, off = word_ids(c, known)
                held.add(before(ids, off, span - 1) * span + ids)
            if held.full():
                yield from give()
        yield from give()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        out = {}
        sides = table.column("side").to_numpy()
        ids, counts = table.column("ids").to_pylist(), table.column("n").to_pylist()
        for side, name in enumerate(("right", "left")):
            at = np.flatnonzero(sides == side)
            k, n = tally(np.frombuffer(b"".join(ids[i] for i in at), np.int32), np.frombuffer(b"".join(counts[i] for i in at), np.int32).astype(np.int64))
            out[name], out[f"{name}_n"] = [k.astype(np.int32).tobytes()], [n.astype(np.int64).tobytes()]
        return pa.table({"w": pa.array([key[0].as_py()], pa.int32()), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})

    return texts.mapInArrow(run, "w int, side int, ids binary, n binary").groupBy("w").applyInArrow(merge, "w int, right binary, right_n binary, left binary, left_n binary")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(m: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that depends on the classes, from counts of class bigrams."""
    return float(xlogx(m).sum() - xlogx(m.sum(axis=1)).sum() - xlogx(m.sum(axis=0)).sum())


def gains(m: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, loops: float, movable: int) -> np.ndarray:
    """Exact rise of ``likelihood`` when a word moves from its class to each of the movable ones.

    ``right`` and ``left`` are the word's counts by following and preceding class, ``loops`` how often it follows itself.
    """
    r, l = right.copy(), left.copy()
    r[own] -= loops
    l[own] -= loops
    base = m.copy()
    base[own] -= r
    base[:, own] -= l
    base[own, own] -= loops
    rows, cols = base.sum(axis=1), base.sum(axis=0)
    head = slice(0, movable)
    line = xlogx(base[head] + r).sum(axis=1) - xlogx(base[head]).sum(axis=1)
    line += xlogx(base[:, head] + l[:, None]).sum(axis=0) - xlogx(base[:, head]).sum(axis=0)
    k = np.arange(movable)
    d = base[k, k]
    line += xlogx(d + r[k] + l[k] + loops) + xlogx(d) - xlogx(d + r[k]) - xlogx(d + l[k])
    rt, lt = r.sum() + loops, l.sum() + loops
    # the word's own counts go to its class's row and column sums; its neighbours' sums stay as they are
    rows_out, cols_out = rows.copy(), cols.copy()
    rows_out += l
    cols_out += r
    line -= xlogx(rows_out[k] + rt) - xlogx(rows_out[k]) + xlogx(cols_out[k] + lt) - xlogx(cols_out[k])
    return line - line[own]


def class_counts(pairs: DataFrame, classes: np.ndarray, size: int) -> np.ndarray:
    """Counts of class bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((size, size), np.int64)
        for b in K.slices(batches):
            for w, ids, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m[classes[w]] += np.bincount(classes[np.frombuffer(ids, np.int32)], np.frombuffer(n, np.int64), size).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    # one classes x classes matrix a task
    return sum((np.frombuffer(r[0], np.int64).reshape(size, size) for r in pairs.select("w", "right", "right_n").mapInArrow(run, "m binary").collect()), np.zeros((size, size), np.int64))


def moves(pairs: DataFrame, classes: np.ndarray, m: np.ndarray, movable: int) -> list[tuple[int, int, float]]:
    """The best class of every word and the rise in likelihood that it brings."""
    words, size, real = len(classes) - 2, len(m), m.astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for b in K.slices(batches):
            for w, ri, rn, li, ln in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if w >= words:
                    continue
                ri, li, rn, ln = np.frombuffer(ri, np.int32), np.frombuffer(li, np.int32), np.frombuffer(rn, np.int64), np.frombuffer(ln, np.int64)
                g = gains(real, int(classes[w]), np.bincount(classes[ri], rn, size), np.bincount(classes[li], ln, size), float(rn[ri == w].sum()), movable)
                best = int(g.argmax())
                for o, v in zip(out, (w, best, float(g[best])), strict=True):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], names=["w", "c", "gain"])

    return sorted(tuple(r) for r in pairs.mapInArrow(run, "w int, c int, gain double").collect())  # a row a word of the vocabulary


def cluster(pairs: DataFrame, counts: np.ndarray, classes: int = CLASSES, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word (rare words and beginnings have their own, last), and the counts of class bigrams."""
    words, size = len(counts), classes + 2
    label = np.empty(words + 2, np.int64)
    label[np.argsort(-counts, kind="stable")] = np.arange(words) % classes
    label[words:] = classes, classes + 1
    m = class_counts(pairs, label, size)
    value, still = likelihood(m), 0
    for turn in range(turns):
        offered = [x for x in moves(pairs, label, m, classes) if x[2] > 1e-6 and x[1] != label[x[0]] and K.mix(np.array([x[0]], np.uint64))[0] % np.uint64(2) == turn % 2]
        offered.sort(key=lambda x: (-x[2], x[0]))
        while offered:
            trial = label.copy()
            trial[[x[0] for x in offered]] = [x[1] for x in offered]
            new = class_counts(pairs, trial, size)
            if likelihood(new) > value:
                label, m, value = trial, new, likelihood(new)
                break
            offered = offered[: len(offered) // 2]
        still = 0 if offered else still + 1
        if still == 2:
            break
    return label, m


def share(spark: SparkSession, values: np.ndarray) -> tuple[str, str]:
    """An array handed to every worker, for ``mapped``."""
    return publish(spark, np.ascontiguousarray(values).view(np.uint8), ".array") if len(values) else "", values.dtype.str


def mapped(shared: tuple[str, str]) -> np.ndarray:
    return np.memmap(SparkFiles.get(shared[0]), shared[1], mode="r") if shared[0] else np.zeros(0, shared[1])


def all_class_counts(texts: DataFrame, known: tuple[str, str], label: np.ndarray, size: int) -> np.ndarray:
    """Counts of class bigrams in all texts."""
    shared = share(texts.sparkSession, label.astype(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes, m = mapped(known), mapped(shared), np.zeros(size * size, np.int64)
        for b in K.slices(batches):
            for c in K.chunks(K.strings(b.column(0))):
                ids, off = word_ids(c, words)
                m += np.bincount(classes[before(ids, off, len(words) + 1)].astype(np.int64) * size + classes[ids], minlength=size * size)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    # one classes x classes matrix a task
    return sum((np.frombuffer(r[0], np.int64).reshape(size, size) for r in texts.mapInArrow(run, "m binary").collect()), np.zeros((size, size), np.int64))


def best_classes(w: np.ndarray, side: np.ndarray, beside: np.ndarray, n: np.ndarray, own: np.ndarray, m: np.ndarray, movable: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, class) of greatest likelihood, from the counts of each word beside a class, in order of words.

    ``side`` is 0 where the class follows, 1 where it precedes; ``own`` is the word's present class.  Exact up to words
    that stand beside their own class.
    """
    m = m.astype(float)
    rows, cols = m.sum(axis=1)[:movable], m.sum(axis=0)[:movable]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    bounds, out = np.append(first, len(w)), []
    begin = 0
    while begin < len(first):
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + WEIGHED, side="right")) - 1)
        at = slice(bounds[begin], bounds[end])
        sd, j, v, o, starts = side[at], beside[at], n[at].astype(float), own[at], first[begin:end] - bounds[begin]
        cell = np.where(sd[:, None] == 0, m[:movable, j].T, m[j, :movable])
        k = np.flatnonzero(o < movable)
        cell[k, o[k]] = np.maximum(cell[k, o[k]] - v[k], 0)
        line = np.add.reduceat(xlogx(cell + v[:, None]) - xlogx(cell), starts, axis=0)
        for s, sums in ((0, rows), (1, cols)):
            total = np.add.reduceat(np.where(sd == s, v, 0), starts)
            left = np.repeat(sums[None, :], len(starts), axis=0)
            mine = np.flatnonzero(o[starts] < movable)
            left[mine, o[starts][mine]] = np.maximum(left[mine, o[starts][mine]] - total[mine], 0)
            line -= xlogx(left + total[:, None]) - xlogx(left)
        out.append(line.argmax(axis=1))
        begin = end
    return w[first], np.concatenate(out) if out else np.zeros(0, np.int64)


def spread(texts: DataFrame, known: tuple[str, str], label: np.ndarray, core: np.ndarray, m: np.ndarray, movable: int) -> np.ndarray:
    """Classes after every word outside the core has moved to its best class."""
    shared, size, words = share(texts.sparkSession, label.astype(np.int16)), len(m), len(label) - 2
    span = 2 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, classes, held = mapped(known), mapped(shared), Held()
        free = np.ones(words + 2, bool)
        free[core] = free[words:] = False

        def give() -> pa.RecordBatch:
            key, n = held.take()
            shard = key // span * SHARDS // words
            first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(key) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(key)) if len(key) else first
            ends = list(zip(first.tolist(), last.tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(shard[first], pa.int64()), pa.array([key[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([n[a:b].astype(np.int32).tobytes() for a, b in ends], pa.binary())], names=["shard", "keys", "n"])

        for b in K.slices(batches):
            for c in K.chunks(K.strings(b.column(0))):
                ids, off = word_ids(c, hashes)
                prior = before(ids, off, words + 1)
                x, y = free[prior], free[ids]
                held.add(np.concatenate([prior[x] * span + classes[ids[x]], ids[y] * span + size + classes[prior[y]]]))
            if held.full():
                yield give()
        yield give()

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        keys, n = tally(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64), np.frombuffer(b"".join(table.column("n").to_pylist()), np.int32).astype(np.int64))
        w, code = keys // span, keys % span
        w, c = best_classes(w, code // size, code % size, n, mapped(shared)[w].astype(np.int64), m, movable)
        return pa.table({"w": pa.array(w, pa.int32()), "c": pa.array(c, pa.int16())})

    moved = texts.mapInArrow(run, "shard long, keys binary, n binary").groupBy("shard").applyInArrow(choose, "w int, c short").toArrow()  # 6 bytes a word
    out = label.copy()
    out[moved.column("w").to_numpy()] = moved.column("c").to_numpy()
    return out


@dataclass(frozen=True)
class Model:
    """What scoring needs: sorted hashes of the vocabulary, classes, and logarithms of both probabilities."""

    known: np.ndarray
    classes: np.ndarray
    transition: np.ndarray
    emission: np.ndarray


def probabilities(label: np.ndarray, m: np.ndarray, counts: np.ndarray, rare_types: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of a class after a class, and of a word (the last is any rare word) in its class."""
    words, size = len(counts), len(m)
    into = m.sum(axis=0).astype(float)[: size - 1] + 1  # nothing leads to a beginning
    own = into / into.sum()
    total, kinds = m.sum(axis=1).astype(float), np.maximum((m > 0).sum(axis=1), 1)
    weight = total / (total + kinds)
    transition = weight[:, None] * m[:, : size - 1] / np.maximum(total, 1)[:, None] + (1 - weight)[:, None] * own
    mass = np.bincount(label[:words], counts, size)
    emission = np.append(counts / np.maximum(mass[label[:words]], 1), 1 / (rare_types + 1))
    return np.log(transition), np.log(emission)


def train(df: DataFrame, text: str = "text", vocabulary: int | None = None, classes: int = CLASSES, turns: int = TURNS, core: int = CORE, rounds: int = ROUNDS) -> Model:
    """Model of all texts of a table; ``vocabulary`` bounds the words that have a class, which else are all but the rare."""
    texts = df.select(F.col(f"`{text}`").cast("string").alias("text"))
    counted = cut(word_counts(texts))
    types = counted.count()
    top = sorted((r[0], r[1]) for r in most_frequent(counted, core if vocabulary is None else vocabulary, tie="hash").collect())
    known, counts = np.array([r[0] for r in top], np.int64), np.array([r[1] for r in top], np.int64)
    pairs = cut(bigrams(texts, known))
    label, m = cluster(pairs, counts, classes, turns)
    if vocabulary is None and len(known) < types:
        every = counted.where((F.col("n") >= LEAST) | (F.col("n") > int(counts.min()))).select("hash", "n").toArrow()  # 16 bytes a word
        hashes, numbers = every.column("hash").to_numpy(), every.column("n").to_numpy()
        outside = ~np.isin(hashes, known)
        whole = np.concatenate([known, hashes[outside]])
        order = np.argsort(whole)
        all_counts = np.concatenate([counts, numbers[outside]])[order]
        own = np.full(len(whole) + 2, classes, np.int64)
        own[-1] = classes + 1
        own[: len(whole)] = np.concatenate([label[: len(known)], np.full(int(outside.sum()), classes)])[order]
        inner, known, counts, label = np.flatnonzero(order < len(known)), whole[order], all_counts, own
        shared = share(df.sparkSession, known)
        for k in range(rounds if outside.any() else 0):
            trial = spread(texts, shared, label, inner, m, classes)
            new = all_class_counts(texts, shared, trial, classes + 2)
            if k and likelihood(new) <= likelihood(m):
                break
            label, m = trial, new
    return Model(known, label, *probabilities(label, m, counts, types - len(known)))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``log_prob`` and ``perplexity``."""
    shared = [share(df.sparkSession, x) for x in (model.known, model.classes.astype(np.int16), model.emission)]
    transition = model.transition

    def make(texts: list[str]) -> list[pa.Array]:
        known, classes, emission = map(mapped, shared)
        size, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        start = len(known) + 1
        for c in K.chunks(texts):
            ids, off = word_ids(c, known)
            p = transition[classes[before(ids, off, start)], classes[ids]] + emission[ids] if len(ids) else np.zeros(0)
            size.append(np.diff(off))
            total.append(np.bincount(np.repeat(np.arange(c.docs), np.diff(off)), p, c.docs))
        n, s = np.concatenate(size), np.concatenate(total)
        return [pa.array(n), pa.array(s), pa.array(np.exp(-s / np.maximum(n, 1)), mask=n == 0)]

    return append(df, text, [StructField("n_words", LongType()), StructField("log_prob", DoubleType()), StructField("perplexity", DoubleType())], make)


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the class model of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", "perplexity", "log_prob", "n_words")
