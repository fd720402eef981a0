"""Approximate nearest neighbours: a navigable small-world graph per shard, searched by all queries, results merged.

Vectors are spread over shards by a hash of their ids.  A shard's graph is a hierarchy: a vector reaches level l with
probability ``LINKS`` ** -l; level 0 has up to twice ``LINKS`` neighbours a vector, the levels above ``LINKS``.  It is
stored as flat arrays: a matrix of neighbours by level, filled up with -1.  Vectors join in batches: a batch is searched
for in the graph so far and compared with itself, its links are chosen by the usual rule of diversity, and their other
ends pruned by it.  Search goes down the levels greedily and then widens to ``BEAM`` candidates at level 0.  Both run for
many vectors at a time, each step an array operation over all of them.

Similarity is the cosine.  Every vector is in a graph.  Queries are the vectors whose id ``every`` divides (all, where it
is 1); a query's neighbours in every shard are merged to the ``NEAREST`` best, ties by id, itself left out.  Work is n log n
for the graphs, and queries times shards for the search, in which each graph goes to as many parts as the queries need.

Defined results: null ids, null or empty vectors, those with a null, infinite or undefined part, those of no length and
those of another dimension than most are left out, as point and as query; of rows that repeat an id the first by its values
counts; fewer than k + 1 vectors give fewer neighbours; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import cut

NEAREST, LINKS, BUILD_BEAM, BEAM = 10, 16, 64, 64
#: The registered query asks for the vectors whose ids this divides, against all.
EVERY = 50
#: Vectors in a shard, about, and queries in a part.
SHARD, BLOCK = 16_384, 16_384


@dataclass
class Graph:
    """Unit vectors and, by level, their neighbours; a level lists only the vectors that reach it."""

    vectors: np.ndarray
    level: np.ndarray
    links: list[np.ndarray]

    def tobytes(self) -> list[bytes]:
        return [self.vectors.tobytes(), self.level.astype(np.int8).tobytes(), *[x.tobytes() for x in self.links]]

    @staticmethod
    def frombytes(parts: list[bytes], dimension: int) -> Graph:
        level = np.frombuffer(parts[1], np.int8)
        width = lambda k: 2 * LINKS if k == 0 else LINKS
        return Graph(np.frombuffer(parts[0], np.float32).reshape(-1, dimension), level, [np.frombuffer(p, np.int32).reshape(-1, width(k)) for k, p in enumerate(parts[2:])])


def widen(g: Graph, queries: np.ndarray, entry: np.ndarray, level: int, beam: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``beam`` vectors that each query meets on a level, best first, and their similarities; -1 and -2 where fewer.

    ``entry`` has a row of starting points a query (-1 for none); ``known`` vectors are in the graph.
    """
    n, links = len(queries), g.links[level]
    seen = np.zeros((n, known + 1), bool)  # the last column stands for "none"
    seen[:, known] = True
    rows = np.arange(n)
    ids = np.full((n, beam), known, np.int64)
    sims = np.full((n, beam), -2.0, np.float32)
    open_ = np.zeros((n, beam), bool)
    start = np.where(entry < 0, known, entry)[:, :beam]
    ids[:, : start.shape[1]] = start
    safe = np.where(start == known, 0, start)
    sims[:, : start.shape[1]] = np.where(start == known, -2, np.einsum("nd,nkd->nk", queries, g.vectors[safe]))
    open_[:, : start.shape[1]] = start != known
    seen[rows[:, None], start] = True
    live = rows
    while True:
        score = np.where(open_[live], sims[live], -3)
        best = score.argmax(axis=1)
        go = score[np.arange(len(live)), best] > -3
        live, best = live[go], best[go]
        if not len(live):
            break
        open_[live, best] = False
        near = links[ids[live, best]].astype(np.int64)
        near[near < 0] = known
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        near[~fresh] = known
        some = fresh.any(axis=1)
        live, near, fresh = live[some], near[some], fresh[some]
        if not len(live):
            live = rows
            continue
        a, b = np.nonzero(fresh)
        sim = np.full(near.shape, -2.0, np.float32)
        sim[a, b] = np.einsum("nd,nd->n", queries[live[a]], g.vectors[near[a, b]])
        all_sims, all_ids = np.concatenate([sims[live], sim], axis=1), np.concatenate([ids[live], near], axis=1)
        all_open = np.concatenate([open_[live], fresh], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[live], ids[live], open_[live] = (np.take_along_axis(x, top, axis=1) for x in (all_sims, all_ids, all_open))
        open_[live] &= sims[live] > -2
        live = rows
    order = np.lexsort((ids, -sims), axis=1)
    ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
    return np.where(sims > -2, ids, -1), sims


def descend(g: Graph, queries: np.ndarray, entry: np.ndarray, top: int, bottom: int, known: int) -> np.ndarray:
    """Entry points after greedy search of the levels top .. bottom + 1."""
    for level in range(top, bottom, -1):
        entry = widen(g, queries, entry, level, 1, known)[0]
    return entry


def diverse(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Links chosen from candidates, best first: one is taken if no link taken so far is nearer to it than its owner; then the rest fill up."""
    n, width = ids.shape
    safe = np.where(ids < 0, 0, ids)
    near = vectors[safe]
    among = near @ near.transpose(0, 2, 1)
    taken, real = np.zeros((n, width), bool), (ids >= 0) & (ids != own[:, None])
    for k in range(width):
        blocked = (taken & (among[:, k, :] > sims[:, k, None])).any(axis=1)
        taken[:, k] = real[:, k] & ~blocked & (taken.sum(axis=1) < most)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * width + np.arange(width)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    bad = np.take_along_axis(rank, order, axis=1) >= 2 * width
    return np.where(bad, -1, out)


def build(vectors: np.ndarray, seed: int = 0) -> tuple[Graph, np.ndarray]:
    """Graph of unit vectors, and which vector stands at each of its places."""
    n = len(vectors)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 6)
    # those of the highest level come first, so that every search can begin at place 0 and upper levels are prefixes
    places = np.argsort(-level, kind="stable")
    vectors, level = np.ascontiguousarray(vectors[places]), level[places]
    tops = int(level[0]) + 1 if n else 1
    g = Graph(vectors, level, [np.full((int((level >= k).sum()), 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(tops)])
    begin = 1
    while begin < n:
        end = min(n, begin + min(max(begin, 16), 1024))
        # one level at a time, so that a batch has one lowest top level
        end = min(end, begin + int((level[begin:end] == level[begin]).sum()))
        new = np.arange(begin, end)
        entry = np.zeros((len(new), 1), np.int64)
        own_level = int(level[begin])
        entry = descend(g, vectors[new], entry, tops - 1, own_level, begin)
        inner = vectors[new] @ vectors[new].T
        np.fill_diagonal(inner, -2)
        for k in range(min(own_level, tops - 1), -1, -1):
            ids, sims = widen(g, vectors[new], entry, k, BUILD_BEAM, begin)
            entry = ids
            most = g.links[k].shape[1] // 2 if k == 0 else g.links[k].shape[1]
            near = min(most, len(new) - 1)
            if near > 0:
                mates = np.argpartition(-inner, near - 1, axis=1)[:, :near]
                both, both_sims = np.concatenate([ids, new[mates]], axis=1), np.concatenate([sims, np.take_along_axis(inner, mates, axis=1)], axis=1)
            else:
                both, both_sims = ids, sims
            order = np.argsort(-both_sims, axis=1, kind="stable")[:, : 3 * LINKS]
            both, both_sims = np.take_along_axis(both, order, axis=1), np.take_along_axis(both_sims, order, axis=1)
            chosen = diverse(vectors, new, both, both_sims, most)
            g.links[k][new, : chosen.shape[1]] = chosen
            connect(g, k, new, chosen)
        begin = end
    return g, places


def connect(g: Graph, k: int, new: np.ndarray, chosen: np.ndarray) -> None:
    """Add the links back from the chosen neighbours; where one has too many, choose again among all."""
    links, width = g.links[k], g.links[k].shape[1]
    a = np.repeat(new, chosen.shape[1])
    b = chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    ends, first, count = np.unique(b, return_index=True, return_counts=True)
    place = np.arange(len(b)) - np.repeat(first, count)
    extra = np.full((len(ends), int(count.max(initial=1))), -1, np.int64)
    extra[np.repeat(np.arange(len(ends)), count), place] = a
    both = np.concatenate([links[ends].astype(np.int64), extra], axis=1)
    both = np.sort(both, axis=1)[:, ::-1]
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    size = (both >= 0).sum(axis=1)
    both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
    fit = size <= width
    links[ends[fit], : min(width, both.shape[1])] = both[fit][:, :width]
    for i in range(0, int((~fit).sum()), 512):
        at = np.flatnonzero(~fit)[i : i + 512]
        ids = both[at][:, : int(size[at].max())]
        safe = np.where(ids < 0, 0, ids)
        sims = np.where(ids < 0, -2, np.einsum("nd,nkd->nk", g.vectors[ends[at]], g.vectors[safe])).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        links[ends[at]] = diverse(g.vectors, ends[at], ids, sims, width)


def search(g: Graph, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and similarities of the k best vectors of a graph for each query."""
    n, ids, sims = len(g.vectors), [np.zeros((0, k), np.int64)], [np.zeros((0, k), np.float32)]
    for i in range(0, len(queries), 1024):
        part = queries[i : i + 1024]
        entry = descend(g, part, np.zeros((len(part), 1), np.int64), len(g.links) - 1, 0, n)
        a, b = widen(g, part, entry, 0, max(beam, k), n)
        ids.append(a[:, :k])
        sims.append(b[:, :k])
    return np.concatenate(ids), np.concatenate(sims)


def unit_vectors(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(id, unit) of the usable vectors, a row an id, as bytes of 32-bit floats, cut; and their dimension."""
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity'))")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = sizes[0][0] if sizes else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, dimension)
            length = np.sqrt((v * v).sum(axis=1))
            ok = length > 0
            unit = (v[ok] / length[ok, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([x.tobytes() for x in unit], pa.binary())], names=["id", "unit"])

    one = rows.where(F.size("v") == dimension).groupBy("id").agg(F.min("v").alias("v"))
    return cut(one.mapInArrow(run, "id long, unit binary")), dimension


def neighbours(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST, shard: int = SHARD, beam: int = BEAM, every: int = 1) -> DataFrame:
    """(vec_id, rank, neighbour_id, similarity): the k nearest, among all vectors, of those whose id ``every`` divides."""
    points, dimension = unit_vectors(df, vec_id, embedding)
    queries = points.where(F.pmod("id", F.lit(every)) == 0)
    n, asked_for = points.count(), queries.count()
    shards = max(1, round(n / shard))
    # parts of the queries: enough to occupy the cluster, and each of a bounded size
    parts = max(1, -(-asked_for // BLOCK), min(-(-2 * df.sparkSession.sparkContext.defaultParallelism // shards), asked_for // 512))

    def make(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        g, places = build(np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(-1, dimension), int(key[0].as_py()))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([ids[places].tobytes()], pa.binary()), "graph": pa.array([g.tobytes()], pa.list_(pa.binary()))})

    graphs = cut(points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(make, "shard int, ids binary, graph array<binary>"))

    def find(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "near": []}
        kind = pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())]))
        if left.num_rows and right.num_rows:
            names = np.frombuffer(left.column("ids")[0].as_py(), np.int64)
            g = Graph.frombytes(left.column("graph")[0].as_py(), dimension)
            asked = right.column("id").to_numpy()
            places, sims = search(g, np.frombuffer(b"".join(right.column("unit").to_pylist()), np.float32).reshape(-1, dimension), k + 1, beam)
            for q, p, s in zip(asked.tolist(), places, sims.astype(float), strict=True):
                out["id"].append(q)
                out["near"].append([{"far": -x, "id": i} for i, x, ok in zip(names[np.maximum(p, 0)].tolist(), s.tolist(), (p >= 0).tolist(), strict=True) if ok and i != q][:k])
        return pa.table({"id": pa.array(out["id"], pa.int64()), "near": pa.array(out["near"], kind)})

    left = graphs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = queries.withColumn("part", F.pmod(F.xxhash64("id", F.lit("q")), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(find, "id long, near array<struct<far: double, id: long>>")
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select(F.col("id").alias("vec_id"), F.posexplode("near").alias("rank", "x")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), F.round(-F.col("x.far"), 6).alias("similarity"))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours, among all embeddings, of every embedding whose id 50 divides."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=EVERY)
