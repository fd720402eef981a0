"""N-gram Jaccard self-join: an LSH forest of MinHash prefixes proposes, exact set intersection decides.

A document is the set of hashes of its word trigrams (of all its words, where it has fewer).  ``TREES`` trees each order
the sets by ``DEPTH`` MinHash values; sets are neighbours in a tree when their values agree on a prefix.  The search
begins with whole prefixes.  Signatures estimate the similarity of the pairs that such prefixes propose, and from it how
many pairs they miss (a pair of similarity J stands for 1 / (1 - (1 - J^d)^TREES) pairs).  While the estimated recall of
any band of similarity, a tenth wide, is below ``RECALL``, the prefixes are shortened by one value.  The pairs proposed at
the last depth are verified by exact intersection of the sets.  A threshold so low that prefixes of one value would miss
the recall is refused.

Scale.  Documents with the same set are one node from the start.  Nodes that share a prefix get a common leader (the
least they meet); the nodes of a leader, and those of two leaders that meet in a prefix, form units of work, split when
they are large, and every pair of sets belongs to one unit.  So a set is sent once per unit instead of once per pair, and
a unit's intersections come from matrix products.  No candidate is dropped.  What leaves a unit is a row a set: how many
documents it is linked with there, and a spanning star of the linked sets; so a group of thousands of near copies gives
rows in proportion to its documents, while every link is counted.

``classes`` gives one row a document, its class and its number of links; ``pairs`` gives the pairs of different sets and
``copies`` the membership of the equal ones.

Defined results: null ids are left out (``stage`` keeps such rows); null and empty texts, and texts without words, are
classes of their own without links; rows that repeat an id are one document, each of its different sets counts its own
links, and all of them are in one class; an empty table gives no rows; only the id and text columns are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .store import cut

GRAM, THRESHOLD = 3, 0.5
TREES, DEPTH, RECALL = 24, 4, 0.97
#: Bands of similarity, each of which has to reach the recall.
BANDS = 10
#: A unit of more members is split in parts of half that size.
UNIT = 2048
#: Up to so many ids are broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingles(texts: list[str], n: int = GRAM) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text in turn."""
    for c in K.chunks(texts):
        w = K.words(c)
        grams = K.ngram_hash(w.hash, n)
        for a, b in zip(w.off[:-1], w.off[1:], strict=True):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            else:
                yield K.ngram_hash(w.hash[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64)


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two words that stand for a set."""
    return int(K.mix(s).sum()), int(K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum())


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash values of a set, ``DEPTH`` for each tree."""
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, ((s[i : i + 1024, None] * _MULTIPLY + _ADD) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint32)


def prefixes(signatures: np.ndarray, depth: int) -> np.ndarray:
    """A key for the first ``depth`` values of each tree, by document."""
    v = signatures.reshape(-1, TREES, DEPTH).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), v.shape[:2])
    for k in range(depth):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, k])
    return key.view(np.int64)


def found_at(j: np.ndarray | float, depth: int) -> np.ndarray | float:
    """Probability that a pair of similarity j shares a prefix in some tree."""
    return 1 - (1 - j**depth) ** TREES


def sketch(docs: DataFrame) -> DataFrame:
    """(id, set hash of two words, signature) of every document, null where it has no words, from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            both, sig = [], []
            for s in shingles(K.strings(b.column(1))):
                both.append(set_hash(s) if len(s) else (0, 0))
                sig.append(signature(s).tobytes() if len(s) else None)
            none = np.array([x is None for x in sig], bool)
            h1, h2 = np.array(both, np.uint64).reshape(-1, 2).view(np.int64).T.copy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h1, mask=none), pa.array(h2, mask=none), pa.array(sig, pa.binary())], names=["id", "h1", "h2", "sig"])

    return docs.mapInArrow(run, "id long, h1 long, h2 long, sig binary")


def buckets(nodes: DataFrame, depth: int) -> DataFrame:
    """(key, id, least) of every prefix of this depth that several nodes share; a node's id is ``h1``, least the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            if b.num_rows:
                keys = prefixes(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32), depth)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), TREES))], names=["key", "id"])

    keyed = nodes.select("h1", "sig").mapInArrow(run, "key long, id long")
    # a node more than once in a bucket is two sets of one first hash word, which have to be compared too
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    return cut(keyed.join(shared, "key").distinct())


def units(shared: DataFrame) -> DataFrame:
    """(u, v, i, j, id, leader, part): the units of work in which each node takes part."""
    leaders = shared.groupBy("id").agg(F.min("least").alias("leader"))
    met = shared.select("key", "id").join(leaders, "id")
    other = met.groupBy("key").agg(F.collect_set("leader").alias("all")).where(F.size("all") > 1)
    cross = met.join(other, "key").select("id", "leader", F.explode("all").alias("second")).where("leader <> second")
    own = leaders.select("id", "leader", F.col("leader").alias("second"))
    member = own.unionByName(cross.distinct()).select(F.least("leader", "second").alias("u"), F.greatest("leader", "second").alias("v"), "id", "leader")
    member = cut(member.distinct())
    sizes = member.groupBy("u", "v").agg(F.ceil(F.count("*") / (UNIT / 2)).cast("int").alias("parts"), F.count("*").alias("n"))
    sizes = sizes.select("u", "v", F.when(F.col("n") > UNIT, F.col("parts")).otherwise(1).alias("parts"))
    split = member.join(sizes, ["u", "v"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    split = split.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return split.select("u", "v", F.least("part", "k").alias("i"), F.greatest("part", "k").alias("j"), "id", "leader", "part")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1
    place = np.cumsum(several) - 1
    use = several[column]
    owner, column = owner[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, out = int(several.sum()), np.zeros((g, g), np.float32)
    width = min(max(256, (1 << 22) // g), total)
    for begin in range(0, total, max(width, 1)):
        a, b = np.searchsorted(column, [begin, begin + width])
        m = np.zeros((g, width), np.float32)
        m[owner[a:b], column[a:b] - begin] = 1
        out += m @ m.T
    return out


def verified(leaders: np.ndarray, parts: np.ndarray, unit: tuple[int, int, int, int], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, similarity), x < y, of the pairs of sets of one unit that reach the threshold."""
    u, v, i, j = unit
    size, common = np.array([len(s) for s in sets], np.int64), overlaps(sets)
    wide, near, out = size.astype(np.float32), np.float32(threshold / (1 + threshold) * (1 - 1e-5)), []
    for a in range(0, len(sets), 256):
        b = min(a + 256, len(sets))
        # about the threshold here, exactly below
        ok = common[a:b, a:] >= near * (wide[a:b, None] + wide[None, a:])
        if u != v:
            ok &= leaders[a:b, None] != leaders[None, a:]
        if i != j:
            ok &= parts[a:b, None] != parts[None, a:]
        x, y = np.nonzero(ok)
        out.append((x[y > x] + a, y[y > x] + a))
    x, y = (np.concatenate([o[k] for o in out]) for k in range(2))
    same = common[x, y].astype(np.int64)
    similar = same / (size[x] + size[y] - same)
    ok = similar >= threshold
    return x[ok], y[ok], similar[ok]


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n places, the least place that the pairs connect it with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def band(j: np.ndarray, threshold: float) -> np.ndarray:
    """Band of each similarity from the threshold up."""
    return np.clip(((j - threshold) * BANDS + 1e-9).astype(np.int64), 0, BANDS)


def scattered(work: DataFrame) -> DataFrame:
    """Units over all partitions: a unit's work grows with the square of its rows, so bytes say little about it."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), "u", "v", "i", "j")


def estimate(member: DataFrame, nodes: DataFrame, depth: int, threshold: float) -> float:
    """Least recall of any band that prefixes of this depth are estimated to reach, by the signatures of what they propose."""

    keys = ["u", "v", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, weight = np.zeros(BANDS + 1, np.int64), np.zeros(BANDS + 1)
        held: list[tuple[np.ndarray, ...]] = []

        def close() -> None:
            key, leader, part, sig = (np.concatenate(x) for x in zip(*held, strict=True))
            # a value at its place is an element, so equal signatures have all elements in common
            tagged = list(sig.astype(np.uint64) + (np.arange(TREES * DEPTH, dtype=np.uint64) << np.uint64(32)))
            s = verified(leader, part, tuple(key[0].tolist()), tagged, threshold / (2 - threshold))[2]
            j = 2 * s / (1 + s)  # the share of places at which two signatures agree
            at = band(j, threshold)
            n[:] += np.bincount(at, minlength=BANDS + 1)
            weight[:] += np.bincount(at, 1 / found_at(j, depth), BANDS + 1)
            held.clear()

        for b in batches:  # sorted, so a unit's rows follow each other
            key = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            leader, part = b.column(4).to_numpy(), b.column(5).to_numpy()
            sig = np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y:
                    if held and (held[0][0][0] != key[x]).any():
                        close()
                    held.append((key[x:y], leader[x:y], part[x:y], sig[x:y]))
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(range(BANDS + 1), pa.int32()), pa.array(n), pa.array(weight)], names=["band", "n", "weight"])

    # units in turn within a partition: most are small, and a call for each would cost more than its pairs
    work = scattered(member.join(nodes.select(F.col("h1").alias("id"), "sig"), "id")).sortWithinPartitions(*keys).select(*keys, "leader", "part", "sig")
    found = work.mapInArrow(run, "band int, n long, weight double").groupBy("band").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    seen = {r["band"]: r["n"] / r["weight"] for r in found.collect() if r["n"]}  # a row a band
    # of a band in which nothing was proposed, what its middle says
    return min(seen.get(k, found_at(min(1.0, threshold + (k + 0.5) / BANDS), depth)) for k in range(BANDS + 1))


def forest(nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """The units of work at the longest prefixes that reach the recall."""
    if found_at(threshold, 1) < recall:
        raise ValueError(f"a threshold of {threshold} is too low for a recall of {recall} with {TREES} trees")
    for depth in range(DEPTH, 0, -1):
        member = cut(units(buckets(nodes, depth)))
        if depth == 1 or estimate(member, nodes, depth, threshold) >= recall:
            return member


def prepare(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, text) of the documents, (id, h1, h2) of each document's sets, and a node for each distinct set."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id IS NOT NULL")
    base = cut(sketch(docs))
    records = base.select("id", "h1", "h2").distinct()
    sized = records.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    signed = base.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.first("sig").alias("sig"))
    return docs, records, cut(sized.join(signed, ["h1", "h2"]))


def work(docs: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> GroupedData:
    """The units of work with the sets of their members."""
    member = forest(nodes, threshold, recall)
    member = member.join(nodes.select(F.col("h1").alias("id"), "h1", "h2", "least", "n"), "id")
    needed = member.select(F.col("least").alias("id")).distinct()
    # size-checked: beyond the bound the texts are shuffled to the ids
    if needed.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches):
            found = [s for s in shingles(K.strings(b.column(1))) if len(s)]
            h1, h2 = np.array([set_hash(s) for s in found], np.uint64).reshape(-1, 2).view(np.int64).T.copy()
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([s.tobytes() for s in found], pa.binary())], names=["h1", "h2", "shingles"])

    hashed = docs.join(needed, "id", "left_semi").mapInArrow(sets, "h1 long, h2 long, shingles binary")
    one = hashed.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))  # rows that repeat a document
    return scattered(member.join(one, ["h1", "h2"])).groupBy("u", "v", "i", "j")


def checked(key: tuple, table: pa.Table, threshold: float) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A unit's members in order of their least documents, and its pairs."""
    table = table.sort_by([("least", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
    sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
    return table, *verified(table.column("leader").to_numpy(), table.column("part").to_numpy(), tuple(int(k.as_py()) for k in key), sets, threshold)


def linked(docs: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(h1, h2, least, root, links): each set's links with documents of other sets in a unit, and the least document there."""

    def check(key: tuple, table: pa.Table) -> pa.Table:
        table, x, y, _ = checked(key, table, threshold)
        n = table.column("n").to_numpy()
        links = np.bincount(x, n[y], len(n)) + np.bincount(y, n[x], len(n))
        some = np.flatnonzero(links)
        root = table.column("least").to_numpy()[roots(len(n), x, y)]
        return pa.table({**{c: table.column(c).take(some) for c in ("h1", "h2", "least")}, "root": pa.array(root[some], pa.int64()), "links": pa.array(links[some].astype(np.int64))})

    return cut(work(docs, nodes, threshold, recall).applyInArrow(check, "h1 long, h2 long, least long, root long, links long"))


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links), a row a document.

    Documents are linked whose sets have a similarity of ``threshold`` or more; ``n_links`` counts the other documents that
    one is linked with, those of an equal set included, and ``class_id`` is the least document that links lead to.
    """
    docs, records, nodes = prepare(df, doc_id, text)
    found = linked(docs, nodes, threshold, recall)
    records = records.join(nodes.select("h1", "h2", "least", "n"), ["h1", "h2"], "left")
    records = cut(records.join(found.groupBy("h1", "h2").agg(F.sum("links").alias("links")), ["h1", "h2"], "left").select("id", F.coalesce("least", "id").alias("least"), (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("links")))
    several = records.groupBy("id").agg(F.min("least").alias("least"), F.max("least").alias("most")).where("least < most").select("id")
    # documents of several sets tie them together
    ties = records.join(several, "id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    labels = components(found.where("least <> root").select(F.col("root").alias("a"), F.col("least").alias("b")).unionByName(ties))
    done = records.join(labels.select(F.col("id").alias("least"), "root"), "least", "left").groupBy("id").agg(F.min(F.coalesce("root", "least")).alias("class_id"), F.sum("links").alias("n_links"))
    return done.select(F.col("id").alias("doc_id"), "class_id", "n_links")


def pairs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of every pair of different sets that reach ``threshold``, each by its least document."""
    docs, _, nodes = prepare(df, doc_id, text)

    def check(key: tuple, table: pa.Table) -> pa.Table:
        table, x, y, s = checked(key, table, threshold)
        least = table.column("least").to_numpy()
        return pa.table({"doc_id_a": pa.array(least[x], pa.int64()), "doc_id_b": pa.array(least[y], pa.int64()), "jaccard": pa.array(s, pa.float64())})

    return work(docs, nodes, threshold, recall).applyInArrow(check, "doc_id_a long, doc_id_b long, jaccard double").where("doc_id_a <> doc_id_b")


def copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, least): every document and the least one that has its set."""
    _, records, nodes = prepare(df, doc_id, text)
    return records.join(nodes.select("h1", "h2", "least"), ["h1", "h2"]).select(F.col("id").alias("doc_id"), "least")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for each id in the edges (a, b), the least id that it hangs together with."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("id"), "root"))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("least"))
        new = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("root").alias("old"), F.least("root", "least").alias("root"))
        # a root's own root: halves the remaining distance
        up = new.select(F.col("id").alias("root"), F.col("root").alias("above"))
        new = cut(new.join(up, "root").select("id", "old", F.least("root", "above").alias("root")))
        if not new.where("old <> root").limit(1).count():
            return new.select("id", "root")
        labels = new.select("id", "root")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of documents linked by a Jaccard similarity of trigrams of 0.5 or more, and its number of links."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that links lead from to a document of a lower id; rows without an id stay."""
    gone = cut(classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")))
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["__gone"], "left_anti")
