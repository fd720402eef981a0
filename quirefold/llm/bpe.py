"""Byte-level BPE through a transducer lexicon: frequent words are found by walking an automaton, others are merged.

Texts are split in pieces by the usual byte-level pattern (contractions, words, numbers and signs with the space before
them, white space), as array expressions over character classes.  The lexicon is a minimal acyclic automaton of the
corpus's most frequent pieces: suffixes are shared, and each transition carries the number of words that sort before it,
so the sum along a path is the word's place, where its token ids stand.  It is laid out as a double array in one file,
which Spark hands to the executors and each worker maps into memory.  All pieces of a chunk walk it together, one byte a
step.  A piece outside the lexicon is merged exactly, lowest rank first and leftmost of equals, again many at once.

Defined results: null and empty texts have no tokens; extra columns pass through and those that clash with new names are
replaced; repeated rows get equal tokens; an empty table gives an empty table (the lexicon is then empty and every piece
is merged).
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField

from . import textkernel as K
from .columns import append, most_frequent
from .store import cut, publish

#: Ranks of a byte-level vocabulary: a token in base 64 and its id, a line each.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words in the lexicon; those that occur once are never in it.
LEXICON = 65_536
_LONG, _CACHE = 48, 131_072
_NONE = np.int32(0x7FFFFFFF)


# --- pieces


def pieces(c: K.Chunk) -> np.ndarray:
    """Index of the first character of each piece of a chunk, and the number of characters at the end."""
    n, cp = len(c.cp), c.cp
    if not n:
        return np.zeros(1, np.int64)
    kind = K.char_class()[cp]
    kind[kind == K.MARK] = K.OTHER
    edge = np.zeros(n + 1, bool)
    edge[c.off] = True
    start = edge.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last of some white space before other text stands alone or, if it is a space, with what follows
    last = np.flatnonzero((kind[:-1] == K.SPACE) & (kind[1:] != K.SPACE) & ~edge[1:n])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    # contractions
    quote = np.flatnonzero((cp == 39) & start[:n])
    at = lambda k: np.where((quote + k < n) & (np.searchsorted(c.off, quote, side="right") == np.searchsorted(c.off, np.minimum(quote + k, n - 1), side="right")), cp[np.minimum(quote + k, n - 1)], 0)
    one, two = at(1), at(2)
    short = quote[np.isin(one, [115, 116, 109, 100])]
    long = quote[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]
    for q, k in ((short, 1), (long, 2)):
        start[q + 1] = False
        after = q + k + 1
        after = after[after < n]
        after = after[kind[after] == K.LETTER]
        start[after] = True
    return np.flatnonzero(start)


# --- merging


@dataclass
class Vocabulary:
    """Tokens' bytes end to end, and the rank of each pair of tokens that merges, in an open hash table."""

    data: np.ndarray
    off: np.ndarray
    single: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``_NONE`` where a token is -1 or the two do not merge."""
        key = (a.astype(np.int64) << 32) | b
        key[(a < 0) | (b < 0)] = -2
        slot = _slot(key, len(self.pair_keys))
        held = self.pair_keys[slot]
        out = np.where(held == key, self.pair_ranks[slot], _NONE)
        open_ = np.flatnonzero((held != key) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.pair_keys)
            held = self.pair_keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.pair_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _table(keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open hash table of the pairs, at most a quarter full."""
    size = 1 << max(4, int(4 * len(keys)).bit_length())
    held, value = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
    left, slot = np.arange(len(keys)), _slot(keys, size)
    while len(left):
        free = np.flatnonzero(held[slot] == -1)
        _, first = np.unique(slot[free], return_index=True)
        put = free[first]
        held[slot[put]], value[slot[put]] = keys[left[put]], ranks[left[put]]
        stay = np.ones(len(left), bool)
        stay[put] = False
        left, slot = left[stay], (slot[stay] + 1) % size
    return held, value


def read_vocabulary(path: str) -> Vocabulary:
    """Vocabulary from a file of ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, r in ranks.items():
        by_id[r] = token
    pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
    off = np.zeros(len(by_id) + 1, np.int32)
    np.cumsum([len(t) for t in by_id], out=off[1:])
    single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
    return Vocabulary(np.frombuffer(b"".join(by_id), np.uint8), off, single, *_table(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)))


def merge_one(v: Vocabulary, piece: bytes) -> list[int]:
    """Tokens of one piece of any length, by a heap of pairs."""
    ids = v.single[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    rank = lambda i: int(v.rank(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
    first = v.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist() if n > 1 else []
    heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != _NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = r, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (q := rank(k)) != _NONE:
                heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
    return [x for x, ok in zip(ids, alive, strict=True) if ok]


def merge_many(v: Vocabulary, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the pieces end to end, and where each piece's begin: the lowest rank, leftmost of equals, merges first."""
    size = np.array([len(p) for p in found], np.int64)
    count = size.copy()
    rows = np.argsort(size, kind="stable")
    rows = rows[(size[rows] > 0) & (size[rows] <= _LONG)]
    done: list[tuple[np.ndarray, np.ndarray]] = []  # pieces, and their tokens as columns filled up with -1
    for begin in range(0, len(rows), 4096):
        part = rows[begin : begin + 4096]
        width = int(size[part[-1]])
        flat = np.full((len(part), width + 1), -1, np.int32)
        flat[np.arange(width + 1) < size[part][:, None]] = v.single[np.frombuffer(b"".join([found[i] for i in part]), np.uint8)]
        ids = np.ascontiguousarray(flat.T)  # a row for each place in the piece, so that all steps run along pieces
        ranks = np.stack([v.rank(ids[k], ids[k + 1]) for k in range(width)])
        while True:
            best = ranks.argmin(axis=0)
            line = np.arange(len(part))
            r = ranks[best, line]
            over = r == _NONE
            if over.sum() * 4 >= len(part) or over.all():
                done.append((part[over], ids[:, over]))
                go = ~over
                part, ids, ranks, best, r, over = part[go], ids[:, go], ranks[:, go], best[go], r[go], over[go]
                line = np.arange(len(part))
                if not len(part):
                    break
            best = np.where(over, width + 1, best)
            for k in range(1, width + 1):  # what is right of the merged pair moves one place to the left
                move = best < k
                if k < width:
                    ids[k] = np.where(move, ids[k + 1], ids[k])
                    ranks[k - 1] = np.where(best < k - 1, ranks[k], ranks[k - 1])
                else:
                    ids[k] = np.where(move, -1, ids[k])
                    ranks[k - 1] = np.where(best < k - 1, _NONE, ranks[k - 1])
            go = np.flatnonzero(~over)
            at, new = best[go], r[go]
            ids[at, go] = new
            ranks[at, go] = v.rank(new, ids[at + 1, go])
            has = at > 0
            ranks[at[has] - 1, go[has]] = v.rank(ids[at[has] - 1, go[has]], new[has])
    alone = {int(i): np.array(merge_one(v, found[i]), np.int32) for i in np.flatnonzero(size > _LONG)}
    for part, ids in done:
        count[part] = (ids >= 0).sum(axis=0)
    for i, x in alone.items():
        count[i] = len(x)
    off = np.zeros(len(found) + 1, np.int64)
    np.cumsum(count, out=off[1:])
    out = np.zeros(off[-1], np.int32)
    for part, ids in done:
        for k in range(ids.shape[0]):
            use = np.flatnonzero(ids[k] >= 0)
            out[off[part[use]] + k] = ids[k, use]
    for i, x in alone.items():
        out[off[i] : off[i + 1]] = x
    return out, off


# --- lexicon


def automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words as a double array: base, check, target, skip, final.

    From state s the transition by byte b is at t = base[s] + b if check[t] = s; it leads to target[t] and adds skip[t].
    """
    register: dict[tuple, int] = {}
    edges: list[list[tuple[int, int]]] = [[]]
    final: list[bool] = [False]
    path, before = [0], b""

    def freeze(depth: int) -> None:
        while len(path) - 1 > depth:
            child, parent = path.pop(), path[-1]
            b, _ = edges[parent][-1]
            same = register.setdefault((final[child], tuple(edges[child])), child)
            edges[parent][-1] = (b, same)

    for w in words:
        k = 0
        while k < min(len(w), len(before)) and w[k] == before[k]:
            k += 1
        freeze(k)
        for b in w[k:]:
            edges.append([])
            final.append(False)
            edges[path[-1]].append((b, len(edges) - 1))
            path.append(len(edges) - 1)
        final[path[-1]] = True
        before = w
    freeze(0)
    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for _, t in edges[stack.pop()]:
            if t not in number:
                number[t] = len(order)
                order.append(t)
                stack.append(t)
    ways: dict[int, int] = {}

    def count(root: int) -> int:
        todo = [root]
        while todo:
            s = todo[-1]
            wait = [t for _, t in edges[s] if t not in ways]
            if wait:
                todo.extend(wait)
            else:
                todo.pop()
                ways[s] = final[s] + sum(ways[t] for _, t in edges[s])
        return ways[root]

    count(0)
    size = sum(len(edges[s]) for s in order) + 1024
    check = np.full(size * 2 + 512, -1, np.int32)
    target, skip = np.zeros_like(check), np.zeros_like(check)
    base, ends = np.zeros(len(order), np.int32), np.array([final[s] for s in order], np.int32)
    free, at, degree, taken = 0, 0, 0, np.zeros(len(check), bool)
    for s in sorted(order, key=lambda s: -len(edges[s])):
        if not edges[s]:
            continue
        labels = np.array([b for b, _ in edges[s]])
        if len(labels) != degree:  # states of one degree are placed in one sweep over what is free
            free, degree = free + int(taken[free:].argmin()), len(labels)
            at = free
        window = 256
        while True:
            if at + window + 512 > len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken), bool)])
                check = np.concatenate([check, np.full(len(check), -1, np.int32)])
                target, skip = np.concatenate([target, np.zeros_like(target)]), np.concatenate([skip, np.zeros_like(skip)])
            bases = at + np.flatnonzero(~taken[at : at + window]) - labels[0]
            bases = bases[bases >= 0]
            fits = np.flatnonzero(~taken[bases[:, None] + labels].any(axis=1))
            if len(fits):
                break
            at += window
        here = int(bases[fits[0]])
        base[number[s]] = here
        less = int(final[s])
        for b, t in edges[s]:
            taken[here + b] = True
            check[here + b], target[here + b], skip[here + b] = number[s], number[t], less
            less += ways[t]
    used = int(np.flatnonzero(check >= 0).max(initial=0)) + 257
    return base, check[:used], target[:used], skip[:used], ends


_ARRAYS = ["data", "off", "single", "pair_keys", "pair_ranks", "base", "check", "target", "skip", "final", "entry_off", "entry_ids"]


class Encoder:
    """Encoding and decoding with a vocabulary and a lexicon, held in arrays that may be mapped files."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays = arrays
        for name, a in arrays.items():
            setattr(self, name, a)
        self.vocabulary = Vocabulary(*[arrays[k] for k in _ARRAYS[:5]])
        self.forget()

    def forget(self) -> None:
        """Empty the cache of merged pieces: their numbers, their tokens end to end and where each one's begin."""
        self.cache: dict[bytes, int] = {}
        self.merged, self.merged_off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Merge pieces and keep their tokens."""
        ids, off = merge_many(self.vocabulary, new)
        self.cache.update(zip(new, range(len(self.cache), len(self.cache) + len(new)), strict=True))
        self.merged_off = np.concatenate([self.merged_off, off[1:] + self.merged_off[-1]])
        self.merged = np.concatenate([self.merged, ids])

    @staticmethod
    def compile(v: Vocabulary, words: list[bytes]) -> Encoder:
        words = sorted({w for w in words if w})
        ids, off = merge_many(v, words)
        return Encoder(dict(zip(_ARRAYS, [v.data, v.off, v.single, v.pair_keys, v.pair_ranks, *automaton(words), off.astype(np.int32), ids], strict=True)))

    def tobytes(self) -> bytes:
        head, at = [], 0
        for k in _ARRAYS:
            a = self.arrays[k]
            head.append([k, a.dtype.str, len(a), at])
            at += -(-a.nbytes // 64) * 64
        first = json.dumps(head).encode().ljust(4096)
        return first + b"".join(np.ascontiguousarray(self.arrays[k]).tobytes().ljust(-(-self.arrays[k].nbytes // 64) * 64, b"\0") for k in _ARRAYS)

    @staticmethod
    def open(path: str) -> Encoder:
        whole = np.memmap(path, np.uint8, mode="r")
        head = json.loads(bytes(whole[:4096]))
        return Encoder({k: np.asarray(whole[4096 + at : 4096 + at + n * np.dtype(d).itemsize].view(d)) for k, d, n, at in head})

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place in the lexicon of each piece of bytes, or -1."""
        out = np.full(len(begin), -1, np.int64)
        live, state, total, at = np.arange(len(begin)), np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32), begin.copy()
        while len(live):
            done = at == end[live]
            if done.any():
                ok = done & (self.final[state] == 1)
                out[live[ok]] = total[ok]
                go = ~done
                live, state, total, at = live[go], state[go], total[go], at[go]
            t = self.base[state] + data[at]
            go = np.flatnonzero(self.check[t] == state)
            live, t = live[go], t[go]
            state, total, at = self.target[t], total[go] + self.skip[t], at[go] + 1
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For runs of texts: which they are, their token ids, and where each text's ids begin."""
        for c in K.chunks(texts):
            raw = "".join(texts[c.rows]).encode()
            data = np.frombuffer(raw, np.uint8)
            first = pieces(c)
            place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            begin, end = place[first[:-1]], place[first[1:]]
            entry = self.find(data, begin, end)
            lost = np.flatnonzero(entry < 0)
            names = [raw[a:b] for a, b in zip(begin[lost].tolist(), end[lost].tolist(), strict=True)]
            if new := [p for p in dict.fromkeys(names) if p not in self.cache]:
                if len(self.cache) + len(new) > _CACHE:
                    self.forget()
                    new = list(dict.fromkeys(names))
                self.learn(new)
            place = np.fromiter(map(self.cache.__getitem__, names), np.int64, len(names))
            known = entry >= 0
            e = entry[known]
            # where in the ids of the lexicon, followed by those merged here, each piece's begin, and how many they are
            origin, count = np.empty(len(entry), np.int64), np.empty(len(entry), np.int64)
            origin[known], count[known] = self.entry_off[e], self.entry_off[e + 1] - self.entry_off[e]
            origin[lost], count[lost] = len(self.entry_ids) + self.merged_off[place], self.merged_off[place + 1] - self.merged_off[place]
            off = np.zeros(len(entry) + 1, np.int64)
            np.cumsum(count, out=off[1:])
            ids = np.concatenate([self.entry_ids, self.merged])[np.repeat(origin - off[:-1], count) + np.arange(off[-1])]
            yield c.rows, ids.astype(np.int32), off[np.searchsorted(first, c.off)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of tokens."""
        a = self.off[ids].astype(np.int64)
        n = self.off[ids + 1] - a
        ends = np.cumsum(n)
        return self.data[np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_opened: dict[str, Encoder] = {}


def opened(name: str) -> Encoder:
    """The encoder in a published file, mapped once per worker."""
    if name not in _opened:
        _opened.clear()
        _opened[name] = Encoder.open(SparkFiles.get(name))
    return _opened[name]


def frequent(df: DataFrame, text: str = "text", most: int = LEXICON) -> list[bytes]:
    """The most frequent pieces over all texts that occur more than once; ties in order of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])
        for b in K.slices(batches):
            texts = K.strings(b.column(0))
            for c in K.chunks(texts):
                first, whole = pieces(c), "".join(texts[c.rows])
                _, at, n = np.unique(K.span_hash(c.cp, first[:-1], first[1:]), return_index=True, return_counts=True)
                for i, j, k in zip(first[at].tolist(), first[at + 1].tolist(), n.tolist(), strict=True):
                    p = whole[i:j]
                    seen[p] = seen.get(p, 0) + k
                if len(seen) > _CACHE:
                    yield give()
                    seen.clear()
        yield give()

    counted = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # most rows, each a short piece
    return [r[0].encode() for r in most_frequent(cut(counted.where("n > 1")), most, tie="piece").collect()]


def compiled(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, most: int = LEXICON) -> str:
    """Name of the published encoder whose lexicon holds the table's frequent pieces."""
    return publish(df.sparkSession, Encoder.compile(read_vocabulary(vocabulary), frequent(df, text, most)).tobytes(), ".bpe")


_TOKENS = [StructField("token_ids", ArrayType(IntegerType(), False)), StructField("n_tokens", IntegerType()), StructField("round_trip", BooleanType())]


def encode(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``df`` with ``token_ids``, ``n_tokens`` and ``round_trip``: whether decoding gives the text again."""

    def make(texts: list[str]) -> list[pa.Array]:
        encoder, ids, size, same = opened(name), [np.zeros(0, np.int32)], [], []
        for rows, found, off in encoder.encode(texts):
            ids.append(found)
            size.append(np.diff(off))
            part = texts[rows]
            if encoder.decode(found) == "".join(part).encode():
                same.extend([True] * len(part))
            else:
                same.extend(encoder.decode(found[a:b]) == t.encode() for t, a, b in zip(part, off[:-1], off[1:], strict=True))
        size_all = np.concatenate([np.zeros(0, np.int64), *size])
        off_all = np.concatenate([[0], np.cumsum(size_all)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(off_all), pa.array(np.concatenate(ids)), type=pa.list_(pa.field("element", pa.int32(), False))), pa.array(size_all.astype(np.int32)), pa.array(same, pa.bool_())]

    return append(df, text, _TOKENS, make)


def decode(df: DataFrame, name: str, ids: str = "token_ids") -> DataFrame:
    """``df`` with ``decoded``: the text of a column of token ids; null ids give null, bytes that are no text U+FFFD."""
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "decoded"])
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            texts = [None if x is None else opened(name).decode(np.array(x, np.int64)).decode(errors="replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, compiled(docs)).select("doc_id", "n_tokens", "round_trip", "token_ids")
