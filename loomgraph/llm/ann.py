"""Approximate nearest neighbours: a navigable small-world hierarchy per shard.

Rows are dealt to shards of about ``shard_rows`` by a hash of their id. Each shard's
distinct vectors become nodes; a node keeps the least ids of its copies. Levels are
drawn from a hash of the node's least id. On each level a node is linked with those of
its nearest members that are nearer to it than to a link it already has, in both
directions; the links are flat arrays, a row of node numbers for each member. Queries
go to every shard and walk down from the top level; the shards' results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomgraph.llm import kernels as K
from loomgraph.llm.store import Scratch

#: Links of a member, on level 0 twice as many and SPARE more that join what would else be out of reach.
LINKS, SPARE, NEAREST, BEAM = 32, 4, 96, 200
#: Queries walked together, and sent to one copy of a shard's index.
TOGETHER, PER_COPY = 256, 1 << 16


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its k nearest others, nearest first, and their cosines. A shard is small enough for all its pairs, by blocks."""
    n = len(x)
    ids, sims = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(s, part, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        ids[lo : lo + 512], sims[lo : lo + 512] = np.take_along_axis(part, order, 1), np.take_along_axis(own, order, 1)
    return ids, sims


def _link(x: np.ndarray, most: int, spare: int) -> np.ndarray:
    """Links of one level, n by most + spare, -1 where there is none."""
    n = len(x)
    out = np.full((n, most + spare), -1, np.int32)
    if n < 2:
        return out
    k = min(NEAREST, n - 1)
    ids, sims = _nearest(x, k)
    kept = np.zeros((n, k), bool)
    for lo in range(0, n, 256):
        near = x[ids[lo : lo + 256]]
        between = near @ near.transpose(0, 2, 1)
        own = kept[lo : lo + 256]
        for j in range(k):
            own[:, j] = ~(own[:, :j] & (between[:, j, :j] > sims[lo : lo + 256, j, None])).any(axis=1) & (own[:, :j].sum(axis=1) < most // 2)
    a, j = np.nonzero(kept)
    b, s = ids[a, j], sims[a, j]
    a, b, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
    order = np.lexsort((b, -s, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b = a[new], b[new]
    rank = np.arange(len(a)) - np.searchsorted(a, np.arange(n))[a]
    fits = rank < most
    out[a[fits], rank[fits]] = b[fits]
    if spare:
        _join_up(x, out, most)
    return out


def _reached(links: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(links), bool)
    seen[0] = True
    front = np.array([0])
    while len(front):
        near = links[front].ravel()
        near = np.unique(near[near >= 0])
        front = near[~seen[near]]
        seen[front] = True
    return seen


def _join_up(x: np.ndarray, links: np.ndarray, most: int) -> None:
    """Use spare places so that every node can be reached from node 0."""
    seen = _reached(links)
    while not seen.all():
        out = np.flatnonzero(~seen)[0]
        order = np.argsort(-(x[seen] @ x[out]), kind="stable")
        free = np.flatnonzero(seen)[order]
        free = free[(links[free, most:] < 0).any(axis=1)]
        near = int(free[0])
        links[near, most + int(np.flatnonzero(links[near, most:] < 0)[0])] = out
        seen = _reached(links)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors in double precision, each by the power of two that brings its largest component near 1: no cosine changes by it, and no square overflows."""
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1])


def build_shard(ids: np.ndarray, vectors: np.ndarray, copies: int) -> dict[str, np.ndarray]:
    """Index of one shard: original vectors, copies' least ids, and a level's members and links for each level."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, first, node = np.unique(vectors.view([("", vectors.dtype)] * vectors.shape[1]).ravel(), return_index=True, return_inverse=True)
    node = node.ravel()
    by_node = np.argsort(node, kind="stable")
    rank = np.arange(len(ids)) - np.searchsorted(node[by_node], np.arange(len(first)))[node[by_node]]
    held = np.full((len(first), copies), -1, np.int64)
    few = rank < copies
    held[node[by_node][few], rank[few]] = ids[by_node][few]
    own = vectors[first]
    wide = scaled(own)
    unit = (wide / np.sqrt((wide * wide).sum(axis=1))[:, None]).astype(np.float32)
    draw = (K.mix(ids[first].view(K.U64) * K.U64(K.BASE)) >> K.U64(11)).astype(np.float64) / 2.0**53
    level = np.floor(-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(int)
    out = {"vectors": own, "held": held, "links0": _link(unit, 2 * LINKS, SPARE)}
    for depth in range(1, int(level.max()) + 1):
        members = np.flatnonzero(level >= depth).astype(np.int32)
        if len(members) < 2:
            break
        out |= {f"members{depth}": members, f"links{depth}": _link(unit[members], LINKS, 0)}
    return out


class Shard:
    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.own, self.held = scaled(arrays["vectors"]), arrays["held"]
        self.norm = np.sqrt((self.own * self.own).sum(axis=1))
        self.unit = (self.own / self.norm[:, None]).astype(np.float32)
        self.links0 = arrays["links0"]
        self.levels = [(arrays[f"members{d}"], arrays[f"links{d}"]) for d in range(1, 99) if f"links{d}" in arrays]

    def _start(self, q: np.ndarray) -> np.ndarray:
        """Node at which each query enters level 0: on each level from the top, on to a nearer link until there is none."""
        at = np.zeros(len(q), np.int64)
        if self.levels:
            at[:] = self.levels[-1][0][0]
        for members, links in reversed(self.levels):
            place = np.searchsorted(members, at)
            best = (self.unit[at] * q).sum(axis=1)
            moving = np.arange(len(q))
            while len(moving):
                near = links[place[moving]]
                sims = np.where(near >= 0, np.einsum("qmd,qd->qm", self.unit[members[near]], q[moving]), -np.inf)
                top = sims.argmax(axis=1)
                value = sims[np.arange(len(moving)), top]
                ok = value > best[moving]
                moving, value, to = moving[ok], value[ok], near[ok, top[ok]]
                best[moving], place[moving] = value, to
            at = members[place].astype(np.int64)
        return at

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Nodes found, one row of up to ``beam`` for each unit query, -1 where there are fewer."""
        n, rows = len(self.unit), np.arange(len(q))
        beam = min(beam, n)
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        ids, sims, done = np.full((len(q), beam), n, np.int64), np.full((len(q), beam), -np.inf, np.float32), np.ones((len(q), beam), bool)
        ids[:, 0] = self._start(q)
        sims[:, 0], done[:, 0] = (self.unit[ids[:, 0]] * q).sum(axis=1), False
        seen[rows, ids[:, 0]] = True
        live = rows
        while len(live):
            pick = np.where(done[live], -np.inf, sims[live]).argmax(axis=1)
            done[live, pick] = True
            near = self.links0[ids[live, pick]].astype(np.int64)
            near[near < 0] = n
            near[seen[live[:, None], near]] = n
            seen[live[:, None], near] = True
            value = np.where(near < n, np.einsum("qmd,qd->qm", self.unit[np.minimum(near, n - 1)], q[live]), -np.inf)
            all_ids, all_sims, all_done = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], value], 1), np.concatenate([done[live], near == n], 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] if all_sims.shape[1] > beam else np.broadcast_to(np.arange(beam), (len(live), beam))
            ids[live], sims[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_sims, all_done))
            live = live[~done[live].all(axis=1)]
        return np.where(sims > -np.inf, ids, -1)

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query id, vector id, cosine), k at most for each query; cosines in double precision on the original vectors."""
        wide = scaled(queries)
        norm = np.sqrt((wide * wide).sum(axis=1))
        found = self.search((wide / norm[:, None]).astype(np.float32), beam)
        safe = np.maximum(found, 0)
        dots = (self.own[safe] * wide[:, None, :]).sum(axis=2)
        cosine = np.where(found >= 0, dots / (self.norm[safe] * norm[:, None]), -np.inf)
        for i, me in enumerate(query_ids):
            best: list[tuple[float, int]] = []
            order = np.argsort(-cosine[i], kind="stable")
            for j in order:
                if cosine[i, j] == -np.inf or (len(best) >= k and cosine[i, j] < best[k - 1][0]):
                    break
                best += [(float(cosine[i, j]), int(v)) for v in self.held[found[i, j]] if v >= 0 and v != me]
                best.sort(key=lambda x: (-x[0], x[1]))
            for score, v in best[:k]:
                yield int(me), v, score


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


_INDEX = "shard int, dim int, names array<string>, kinds array<string>, widths array<int>, arrays array<binary>"


def _vectors(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _typed(rows: DataFrame) -> DataFrame:
    """vec_id and embedding; components are float or double."""
    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select("vec_id", F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>").alias("embedding"))


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
    cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi > lo:
            yield keys[lo], batch.slice(lo, hi - lo)


def _builder(copies: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def flush() -> pa.RecordBatch:
            arrays = build_shard(np.concatenate(ids), np.concatenate(vectors), copies)
            values = [[key[0]], [key[1]], [list(arrays)], [[a.dtype.str for a in arrays.values()]], [[a.shape[1] if a.ndim > 1 else 0 for a in arrays.values()]], [[a.tobytes() for a in arrays.values()]]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "dim", "names", "kinds", "widths", "arrays"])

        for batch in batches:
            for own, part in _runs(batch, "shard", "dim"):
                if own != key:
                    if ids:
                        yield flush()
                    key, ids, vectors = own, [], []
                ids.append(part.column("vec_id").to_numpy())
                vectors.append(_vectors(part, "embedding", key[1]))
        if ids:
            yield flush()

    return run


def build_index(vectors: DataFrame, scratch: Scratch, shard_rows: int, copies: int) -> tuple[DataFrame, DataFrame, int]:
    """Index of (vec_id, embedding): a row for each shard and dimension; the vectors that take part; the number of shards."""
    part = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    part = scratch.keep(part.withColumn("dim", F.size("embedding")), "vectors")
    shards = max(1, math.ceil(part.count() / shard_rows))
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    sorted_ = dealt.repartition(min(4 * shards, 4096), "shard", "dim").sortWithinPartitions("shard", "dim")
    return scratch.keep(sorted_.mapInArrow(_builder(copies), _INDEX), "index"), part, shards


def _searcher(k: int, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key = None, None
        for batch in batches:
            for own, part in _runs(batch, "shard", "dim", "slot", "is_query"):
                if not own[3]:
                    rows = [part.column(c)[0].as_py() for c in ("names", "kinds", "widths", "arrays")]
                    arrays = {n: np.frombuffer(a, t).reshape((-1, w) if w else -1) for n, t, w, a in zip(*rows, strict=True)}
                    shard, key = Shard(arrays), own[:3]
                elif own[:3] == key:
                    ids, queries = part.column("vec_id").to_numpy(), _vectors(part, "embedding", own[1])
                    for lo in range(0, len(ids), TOGETHER):
                        found = list(shard.nearest(ids[lo : lo + TOGETHER], queries[lo : lo + TOGETHER], k, beam))
                        columns = zip(*found, strict=True) if found else ([], [], [])
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, beam: int = BEAM) -> DataFrame:
    """The k nearest of ``vectors`` (vec_id, embedding) found for each of ``queries`` (the same columns), by cosine.

    Returns query_id, rank from 1, vec_id and score, nearest first, ties to the smaller
    vec_id; a query's own id is no candidate. Graphs are walked in single precision, and what
    they find is scored in double precision on the vectors as they are. Vectors that are null, zero or hold null or
    non-finite components take no part, as query or candidate, nor do null ids. Rows that
    repeat an id count as one, with the least of their vectors. Vectors are compared with
    those of their own length only. Other columns aren't looked at. Empty tables give no rows.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    index, _, shards = build_index(_typed(vectors), scratch, shard_rows, k + 1)
    asked = _typed(queries).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.keep(asked, "queries")
    slots = max(1, math.ceil(asked.count() / PER_COPY))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    sent = asked.select(every, F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int").alias("slot"), F.lit(True).alias("is_query"), "vec_id", "embedding")
    copies = index.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).withColumn("is_query", F.lit(False))
    both = copies.unionByName(sent, allowMissingColumns=True).repartition(min(4 * shards * slots, 4096), "shard", "dim", "slot").sortWithinPartitions("shard", "dim", "slot", "is_query")
    found = both.mapInArrow(_searcher(k, beam), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
