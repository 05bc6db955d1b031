"""Approximate nearest neighbours by a robust-pruned directed graph.

Equal vectors are one node (with their smallest ids), so copies neither crowd the graph nor each other's
results. Nodes are dealt by hash over shards of about ``SHARD`` nodes. Each shard builds its graph: nodes
enter in batches of growing size; a greedy search proposes neighbours, relaxed distance pruning keeps a
diverse few of them (a neighbour goes if a kept one is closer to it by the factor ``ALPHA``), and the
reverse edges are pruned the same way. The index is a table of (shard, node, vector, edges, ids). A block
of queries walks every shard with a beam, all its queries at once, and the shards' answers are merged.

Scores are the cosine in double precision on the original vectors. Vectors that are null, zero, or hold
null or non-finite components take no part; vectors of different length only meet their like. Ties go to
the smaller id. A row whose id is null is neither query nor candidate. Repeated ids are candidates each.
"""

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterlab.llm.common import pick, stash

SHARD = 8192        # nodes of a shard
DEGREE = 32         # edges kept per node
BEAM = 64           # candidates kept while building
SEARCH_BEAM = 96    # and while searching
ALPHA = 1.2
QUERY_BLOCK = 4096  # queries that walk a shard together


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the vectors that can be searched."""
    v = pick(vectors, vec_id="long", embedding="array<double>").where("vec_id is not null").withColumnRenamed("embedding", "v")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.where(F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).withColumn(
        "v", F.transform("v", lambda x: x + F.lit(0.0)))  # no negative zeros


def nodes_of(v: DataFrame, keep: int) -> DataFrame:
    """(v, ids): every different vector with the ``keep`` smallest ids that have it."""
    w = Window.partitionBy("v").orderBy("vec_id")
    few = v.withColumn("at", F.row_number().over(w)).where(F.col("at") <= keep)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Graph:
    """A shard's vectors (unit length), edges (padded with -1) and entry node."""

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam, self.alpha = unit.astype(np.float32), degree, beam, alpha
        n = len(unit)
        self.edges = np.full((n, degree), -1, np.int32)
        self.entry = int(np.argmax(self.x @ self.x.mean(axis=0))) if n else -1

    def build(self) -> "Graph":
        n = len(self.x)
        order = np.random.default_rng(n).permutation(n)
        order = np.r_[self.entry, order[order != self.entry]]
        at, size = 1, 1
        while at < n:
            self._insert(order[at:at + size])
            at += size
            size = min(2 * size, 1024, max(1, at))
        return self

    def _insert(self, new: np.ndarray) -> None:
        _, seen = self.search(self.x[new], self.beam)
        near = np.concatenate([seen, np.full((len(new), 1), self.entry)], axis=1)
        self.edges[new] = self._prune(new, near)
        src = np.repeat(new, self.degree)
        dst = self.edges[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, start, count = np.unique(dst, return_index=True, return_counts=True)
        extra = np.full((len(to), int(count.max())), -1, np.int32) if len(to) else np.zeros((0, 1), np.int32)
        extra[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
        held = (self.edges[to] >= 0).sum(axis=1)
        room = held + count <= self.degree
        for lo in range(0, len(to), 1024):
            part = slice(lo, lo + 1024)
            both = np.concatenate([self.edges[to[part]], extra[part]], axis=1)
            simple = room[part]
            packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)
            self.edges[to[part][simple]] = packed[simple, :self.degree]
            if (~simple).any():
                self.edges[to[part][~simple]] = self._prune(to[part][~simple], both[~simple])

    def _prune(self, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
        """At most ``degree`` of the proposed neighbours, nearest first, none that a kept one covers."""
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[near == nodes[:, None]] = -1
        dist = 1 - np.einsum("bd,bkd->bk", self.x[nodes], self.x[near])
        dist[near < 0] = np.inf
        order = np.argsort(dist, axis=1)[:, :3 * self.beam]
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        keep = np.full((len(nodes), self.degree), -1, np.int32)
        vec, rows = self.x[near], np.arange(len(nodes))
        for k in range(self.degree):
            best = np.argmin(dist, axis=1)
            live = np.isfinite(dist[rows, best])
            if not live.any():
                break
            keep[live, k] = near[rows, best][live]
            to_best = 1 - np.einsum("bd,bkd->bk", vec[rows, best], vec)
            dist[(self.alpha * to_best <= dist) & live[:, None]] = np.inf
            dist[rows, best] = np.inf
        return keep

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Of unit queries, all at once: the beam (similarity, node), best first."""
        m = len(q)
        node = np.full((m, beam), -1, np.int32)
        sim = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        node[:, 0], sim[:, 0], open_[:, 0] = self.entry, q @ self.x[self.entry], True
        rows = np.arange(m)
        while len(rows):
            s = np.where(open_[rows], sim[rows], -np.inf)
            best = s.argmax(axis=1)
            go = np.isfinite(s[np.arange(len(rows)), best])
            rows, best = rows[go], best[go]
            if not len(rows):
                break
            open_[rows, best] = False
            near = self.edges[node[rows, best]]
            near = np.where((near[:, :, None] == node[rows][:, None, :]).any(axis=2), -1, near)
            got = np.einsum("bd,bkd->bk", q[rows], self.x[near])
            got[near < 0] = -np.inf
            got[got < sim[rows].min(axis=1)[:, None]] = -np.inf
            all_s = np.concatenate([sim[rows], got], axis=1)
            all_n = np.concatenate([node[rows], near], axis=1)
            all_o = np.concatenate([open_[rows], np.isfinite(got)], axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sim[rows], node[rows] = np.take_along_axis(all_s, top, axis=1), np.take_along_axis(all_n, top, axis=1)
            open_[rows] = np.take_along_axis(all_o, top, axis=1)
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(sim, order, axis=1), np.take_along_axis(node, order, axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def index(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """(shard, dim, node, entry, v, edges, ids) of every node of (v, ids)."""
    n = nodes.count()
    shards = max(1, -(-n // shard))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first").reset_index(drop=True)
        g = Graph(_unit(np.stack(pdf["v"].to_numpy()))).build()
        return pd.DataFrame({"shard": pdf["shard"], "dim": pdf["dim"], "node": np.arange(len(pdf), dtype=np.int32),
                             "entry": np.int32(g.entry), "v": pdf["v"], "edges": list(g.edges), "ids": pdf["ids"]})
    dealt = nodes.withColumn("first", F.get("ids", 0)).withColumn("dim", F.size("v")).withColumn(
        "shard", F.pmod(F.xxhash64("first"), F.lit(shards)).cast("int"))
    return stash(dealt.groupBy("shard", "dim").applyInPandas(
        build, "shard int, dim int, node int, entry int, v array<double>, edges array<int>, ids array<long>"))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search(idx: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query (vec_id, v), without itself."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = idx.groupBy(F.col("shard").alias("at"), F.col("dim").alias("length")).agg(F.count("*").alias("nodes"))
    q = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("v"))
    q = q.join(shards, q["dim"] == shards["length"]).select("vec_id", "v", "block", "dim", F.col("at").alias("shard"))
    i = idx.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def walk(nodes: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(qs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        nodes = nodes.sort_values("node")
        v, ids = np.stack(nodes["v"].to_numpy()), nodes["ids"].to_numpy()
        g = Graph(_unit(v))
        g.entry, g.edges = int(nodes["entry"].iloc[0]), np.stack(nodes["edges"].to_numpy()).astype(np.int32)
        own = qs["vec_id"].to_numpy()
        qv = np.stack(qs["v"].to_numpy())
        out = []
        for at in range(0, len(qs), 512):
            some = qv[at:at + 512]
            _, near = g.search(_unit(some).astype(np.float32), max(beam, k + 1))
            r, c = np.nonzero(near >= 0)
            score = cosine(some[r], v[near[r, c]])
            order = np.lexsort((-score, r))
            r, c, score = r[order], c[order], score[order]
            first = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
            place = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
            for a, b, s in zip(r[place < 4 * k], c[place < 4 * k], score[place < 4 * k]):
                out += [(own[at + a], x, s) for x in ids[near[a, b]] if x != own[at + a]]
        got = pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return got.groupby("query_id").head(k)
    found = i.groupBy("shard", "dim", "block").cogroup(q.groupBy("shard", "dim", "block")).applyInPandas(
        walk, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``; candidates: all rows but the query's own."""
    v = usable(vectors)
    idx = index(nodes_of(v, k + 1))
    return search(idx, v.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"]), k)
