"""Quality classifier: a generalised additive model with pairwise interactions, held as lookup tables.

Training runs on the driver over a bounded sample of labelled texts (``SAMPLE``).  Features are binned by quantiles.
Boosting goes round the features; each step fits a tree of at most three leaves to one feature's histogram of gradients
and adds it, shrunk, to the feature's table.  Then the ``PAIRS`` pairs whose cut in four explains most of what is left
get tables of their own, boosted in the same cyclic manner by trees of depth two.  A text's score is the intercept plus
one table entry per feature and pair: array look-ups and additions.

A label is good when ``quality`` is 1 and ``toxic`` is not 1.  Two of the features are evidence of words: log-odds of
words, and of their first four and five letters, between bad and good texts.  In training, the evidence in one half of
the sample comes from the words of the other half.

Defined results: a null or empty text is scored like any other (all counts 0); labels that are null, or whose document
is missing, are not used; a label given twice counts once where equal, else as bad; without labels of both kinds every
text is kept with probability equal to the share of good (1 without labels); repeated rows get equal scores; empty
tables give empty results; extra columns pass through and those that clash with new names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField

from . import features
from . import textkernel as K
from .columns import append, dropping, unused
from .store import cut

#: At most so many labelled texts train the model, in a pseudo-random order of their ids.
SAMPLE = 20_000
#: A text is kept at this probability of being good, or more.
THRESHOLD = 0.5
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, PAIR_BINS, RATE = 32, 150, 8, 50, 8, 0.1
#: A word is evidence from so many bad texts on, and at such log-odds and likelihood ratio.
LEAST_TEXTS, LEAST_ODDS, LEAST_RATIO = 4, 1.5, 15.0
FEATURES = ["log_chars", "letters", "upper", "numbers", "symbols", "spaces", "repeats", "types", "word_length", "line_words", "repeated_lines", "evidence_sum", "evidence_most", "evidence_rate"]


@dataclass
class Lexicon:
    """Log-odds of word hashes, in order of the hash."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.weights[at], 0.0)


def items(c: K.Chunk, w: K.Words) -> np.ndarray:
    """Three hashes for each word: itself and its first four and five letters (0 where it is no longer than those)."""
    low = K.lower_table()[c.cp]
    size = w.end - w.begin
    out = np.zeros((len(w.hash), 3), np.uint64)
    out[:, 0] = w.hash
    for k, n in ((1, 4), (2, 5)):
        at = np.flatnonzero(size > n)
        out[at, k] = K.mix(K.span_hash(low, w.begin[at], w.begin[at] + n) + np.uint64(n))
    return out


def surface(counts: np.ndarray) -> np.ndarray:
    """The features that come from counts alone."""
    n = {k: counts[:, i].astype(float) for i, k in enumerate(features.NAMES)}
    chars, words, lines = (np.maximum(n[k], 1) for k in ("n_chars", "n_words", "n_lines"))
    return np.stack([
        np.log1p(n["n_chars"]), n["n_letters"] / chars, n["n_upper"] / np.maximum(n["n_letters"], 1), n["n_numbers"] / chars, n["n_symbols"] / chars, n["n_spaces"] / chars,
        n["n_repeats"] / words, n["n_types"] / words ** 0.8, n["n_word_chars"] / words, n["n_words"] / lines, n["n_repeated_lines"] / lines,
    ], axis=1)


def evidence(weights: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum, maximum and rate of word evidence, by document; ``weights`` has the most of each word's three items."""
    docs, n = len(off) - 1, np.diff(off)
    doc = np.repeat(np.arange(docs), n)
    most = np.zeros(docs)
    np.maximum.at(most, doc[weights > 0], weights[weights > 0])
    total = np.bincount(doc, weights, docs)
    return np.stack([total, most, np.bincount(doc, weights > 0, docs) / np.maximum(n, 1)], axis=1)


def featurise(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    out = [np.zeros((0, len(FEATURES)))]
    for c in K.chunks(texts):
        w = K.words(c)
        weights = lexicon.of(items(c, w).ravel()).reshape(-1, 3).max(axis=1) if len(w.hash) else np.zeros(0)
        out.append(np.concatenate([surface(features.measure(c, w)), evidence(weights, w.off)], axis=1))
    return np.concatenate(out)


@dataclass
class Model:
    """Bin edges and tables; scoring adds one entry of each."""

    lexicon: Lexicon
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    constant: float | None = None

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of being good."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[coarse(b[:, f], len(self.tables[f])), coarse(b[:, g], len(self.tables[g]))]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.constant) if self.constant is not None else 1 / (1 + np.exp(-np.clip(self.score(x), -40, 40)))


def coarse(bins: np.ndarray, n: int) -> np.ndarray:
    """The bin of a pair's table in which a feature's bin lies."""
    return bins * min(PAIR_BINS, n) // n


def tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step per bin of the best tree of so many leaves on ordered bins, from sums of gradients and curvatures."""
    cuts, part = [0, len(g)], lambda a, b: (g[a:b].sum() ** 2) / (h[a:b].sum() + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = gl**2 / (hl + 1.0) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + 1.0) - part(a, b)
                best = max(best, (float(gain.max()), a + 1 + int(gain.argmax())))
        if best[1] < 0:
            break
        cuts = sorted({*cuts, best[1]})
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def quarter(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree of depth two on a grid: one cut along each side."""
    best, out = 0.0, np.zeros(g.shape)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + 1.0)
    if min(g.shape) < 2:
        return best, out
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    tops, lefts = (cg[:-1, -1:], ch[:-1, -1:]), (cg[-1:, :-1], ch[-1:, :-1])
    parts = [(a, b), (tops[0] - a, tops[1] - b), (lefts[0] - a, lefts[1] - b), (cg[-1, -1] - tops[0] - lefts[0] + a, ch[-1, -1] - tops[1] - lefts[1] + b)]
    gain = sum(x**2 / (y + 1.0) for x, y in parts) - whole
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, j] > 1e-9:
        best = float(gain[i, j])
        for (x, y), at in zip(parts, (np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :]), strict=True):
            out[at] = x[i, j] / (y[i, j] + 1.0)
    return best, out


def fit(x: np.ndarray, y: np.ndarray, lexicon: Lexicon) -> Model:
    """Model from features and labels (1 good)."""
    if not len(y) or y.min() == y.max():
        return Model(lexicon, 0.0, [], [], [], [], float(y.mean()) if len(y) else 1.0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    m = Model(lexicon, float(np.log(y.mean() / (1 - y.mean()))), edges, [np.zeros(len(e) + 1) for e in edges], [], [])
    b = m.bins(x)
    score = np.full(len(y), m.intercept)

    def state() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, t in enumerate(m.tables):
            if len(t) > 1:
                g, h = state()
                step = RATE * tree(np.bincount(b[:, f], g, len(t)), np.bincount(b[:, f], h, len(t)))
                t += step
                score += step[b[:, f]]
    side = [min(PAIR_BINS, len(t)) for t in m.tables]
    small = np.stack([coarse(b[:, f], len(t)) for f, t in enumerate(m.tables)], axis=1)
    g, h = state()
    grid = lambda i, j, v: np.bincount(small[:, i] * side[j] + small[:, j], v, side[i] * side[j]).reshape(side[i], side[j])
    gains = sorted(((quarter(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(side)) for j in range(i)), reverse=True)
    m.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((side[i], side[j])) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            g, h = state()
            step = RATE * quarter(grid(i, j, g), grid(i, j, h))[1]
            t += step
            score += step[small[:, i], small[:, j]]
    return m


def lexicon_of(df: DataFrame, bad: int, good: int) -> Lexicon:
    """Words in far more of the bad texts than of the good, from rows (hashes, good)."""
    if not bad or not good:
        return Lexicon()
    seen = df.select(F.explode("hashes").alias("hash"), "good").groupBy("hash").agg(F.count_if(~F.col("good")).alias("b"), F.count_if("good").alias("g")).where(F.col("b") >= LEAST_TEXTS)
    rate_b, rate_g, rate = (F.col("b") + 0.5) / (bad + 1), (F.col("g") + 0.5) / (good + 1), (F.col("b") + F.col("g") + 1) / (bad + good + 2)
    odds = seen.withColumn("odds", F.log(rate_b / rate_g)).withColumn("ratio", 2 * (F.col("b") * F.log(rate_b / rate) + F.col("g") * F.log(rate_g / rate)))
    rows = odds.where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO)).select("hash", "odds").collect()  # of a bounded sample
    keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], np.array([r[1] for r in rows], float)[order])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", sample: int = SAMPLE) -> Model:
    """Model from at most ``sample`` labelled texts, one of each id: of several the least."""
    marks = labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull())
    good = (F.col(quality) > 0) & (F.coalesce(F.col(toxic), F.lit(0)) < 1)
    marks = marks.groupBy(F.col(doc_id).alias("__id")).agg(F.min(good).alias("good"))
    # a bounded number of ids, so small enough to broadcast at any size of the corpus
    chosen = marks.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id").groupBy("__id", "good").agg(F.min("text").alias("text")).select("__id", "text", "good")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            texts, counts, hashes = b.column(1).to_pylist(), [], []
            for c in K.chunks(texts):
                w = K.words(c)
                counts.extend(features.measure(c, w).tolist())
                each = items(c, w)
                hashes.extend(np.unique(each[i:j][each[i:j] > 0]).view(np.int64) for i, j in zip(w.off[:-1], w.off[1:], strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.list_(pa.int64())), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "good", "counts", "hashes"])

    got = cut(rows.mapInArrow(prepare, f"id {dict(docs.dtypes)[doc_id]}, good boolean, counts array<long>, hashes array<long>"))
    got = got.withColumn("half", F.xxhash64("id", F.lit("half")) % 2 == 0)
    tally = {(r[0], r[1]): r[2] for r in got.groupBy("half", "good").count().collect()}
    size = lambda half, kind: sum(v for (h, k), v in tally.items() if k == kind and (half is None or h == half))
    halves = {h: lexicon_of(got.where(F.col("half") != h), size(not h, False), size(not h, True)) for h in (True, False)}
    lexicon = lexicon_of(got, size(None, False), size(None, True))
    # the sample again, now with evidence from the other half's words
    again = docs.select(F.col(doc_id).alias("__id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id").groupBy("__id", "good").agg(F.min("text").alias("text")).select("__id", "text", "good").withColumn("half", F.xxhash64("__id", F.lit("half")) % 2 == 0)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            texts, half = b.column(1).to_pylist(), np.array(b.column(3).to_pylist(), bool)
            x = np.zeros((len(texts), len(FEATURES)))
            for h in (True, False):
                at = np.flatnonzero(half == h)
                x[at] = featurise([texts[i] for i in at], halves[h])
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["good", "x"])

    table = again.mapInArrow(describe, "good boolean, x array<double>").toArrow()  # at most ``sample`` rows
    x = np.array(table.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(table.column(0).to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of arrival
    return fit(x[order], y[order], lexicon)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, names: Sequence[str] = ("quality_score", "kept")) -> DataFrame:
    """``df`` with ``quality_score``, the probability of being good, and ``kept``, or by other names."""

    def make(texts: list[str]) -> list[pa.Array]:
        p = model.probability(featurise(texts, model.lexicon))
        return [pa.array(p), pa.array(p >= threshold)]

    return append(df, text, [StructField(names[0], DoubleType()), StructField(names[1], BooleanType())], make)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that the classifier keeps, with its score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("kept").select("doc_id", F.round("quality_score", 9).alias("quality_score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their own columns, whatever their names."""
    own = unused(docs, "score", "kept")
    return dropping(score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), names=own).where(F.col(own[1])), *own)
